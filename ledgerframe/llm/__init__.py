"""Training-data operators: deduplication, licences, tokens, extraction, mixing and quality.

Nothing outside this subpackage imports it. Each module holds one
operator with its own general interface; ``queries`` applies them to the
given tables and derives the digest columns.
"""
