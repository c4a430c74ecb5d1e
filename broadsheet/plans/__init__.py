"""Registered queries over the given tables, each with SQL to check it against."""
