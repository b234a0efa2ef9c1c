"""Column functions: built from Spark expressions, no Python in the row path."""
