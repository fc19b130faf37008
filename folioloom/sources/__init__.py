"""Readers: every format becomes rows of elements."""
