"""Scene relations from the given tables, pipelines, and the query registry."""
