"""Readers and writers of scene files."""
