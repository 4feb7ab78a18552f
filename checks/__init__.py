"""Queries over the given tables that exercise every operator, and the SQL they are compared with."""
