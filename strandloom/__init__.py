"""Strandloom: multi-view line association and clustering on Spark."""
