"""Training-data operators: dedup, archives, tokens, privacy, language, mixing, packing, extraction.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
