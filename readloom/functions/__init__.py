"""Column functions on sequences, qualities and tokens."""
