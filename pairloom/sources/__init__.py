"""Scans of corpora, tables of candidates and results, and their sinks."""
