"""Registered queries: Spark operators over the given tables, with their SQL counterparts."""
