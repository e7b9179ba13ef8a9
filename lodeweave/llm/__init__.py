"""Training-data operators: filters, near-duplicate detection, search, extraction, tokens and mixing.

Nothing else in the library imports this subpackage.
"""
