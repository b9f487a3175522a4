"""Queries over the shared test tables, each with an SQL twin where SQL can express it."""
