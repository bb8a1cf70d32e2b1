"""Training-data operators.

Nothing else in the package imports this subpackage; ``__spark_entry__`` adds
its queries only when it can be imported.
"""
