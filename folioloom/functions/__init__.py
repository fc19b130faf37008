"""Column expressions: text, tables, vectors, locations and checks."""
