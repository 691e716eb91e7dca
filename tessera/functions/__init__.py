"""Column-level functions: text analysis and stemming."""
