"""Fernweave: schema-first documents with relations, on Spark."""
