"""Column-expression builders.  Nothing here runs Python per row."""
