"""Statements: what a script says, and how text becomes that."""
