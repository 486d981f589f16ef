"""Column functions: text, names, display formats, vectors."""
