"""From requests to plans: filters, the text query language, hybrid search."""
