"""Readers (driver tables, derived corpora, example files) and sinks."""
