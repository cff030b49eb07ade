"""Training-data operators: scoring, filtering, deduplication, extraction and mixing of text tables.

Nothing else in the library imports this subpackage.
"""
