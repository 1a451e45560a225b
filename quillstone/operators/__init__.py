"""Operators: relational predicates, spatial search, full text, media similarity."""
