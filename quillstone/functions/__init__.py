"""Column functions: text analysis and geometry."""
