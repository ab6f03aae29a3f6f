"""Domain views over the given tables, and the query catalogue with its SQL counterparts."""
