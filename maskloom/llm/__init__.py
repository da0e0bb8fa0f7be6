"""Training-data operators: deduplication, decontamination, language, personal data, quality, sharding, mixing.

Nothing outside this subpackage imports it.
"""
