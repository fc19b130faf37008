"""Writers: stores of vectors, rows and objects."""
