"""Column functions: typed metadata values, text analysis, vector arithmetic."""
