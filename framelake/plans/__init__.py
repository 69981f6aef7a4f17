"""Queries that apply the operators to tables, and SQL that says the same."""
