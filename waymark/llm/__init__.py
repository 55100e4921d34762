"""Training-data operators: chat repair, quality, mixing, deduplication, tokenisation.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its
queries only if the import succeeds.
"""
