"""Column functions: text folding, names, slugs, formatting."""
