"""Column functions: geography, time, text and vectors."""
