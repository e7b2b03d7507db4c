"""Queries over the operators, and the SQL that each is held against."""
