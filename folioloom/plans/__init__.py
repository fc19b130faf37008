"""Whole plans: load, ingest, search, evaluate; and the registered queries."""
