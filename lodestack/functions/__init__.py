"""Column functions: URLs and search text."""
