"""Operators that prepare large text corpora for training language models.

Nothing outside this subpackage imports it; the entry module adds its queries only if it can be imported.
"""
