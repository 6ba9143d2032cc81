"""Registered queries: compositions of operators over the given tables, each with its SQL."""
