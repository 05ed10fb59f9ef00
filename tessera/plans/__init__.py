"""Parsing and text: predicates, SQL and DDL of several dialects."""
