"""Training-data operators: dedup, language, quality, tokenising, packing, scoring, extraction.

Nothing outside this subpackage imports it.
"""
