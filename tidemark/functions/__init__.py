"""Column functions: null discipline, ratios, labels."""
