"""Training-data operators: near-duplicate search, token output, quality, PII, secrets, packing.

Nothing else in the library imports this subpackage; its queries are added by ``__spark_entry__``.
"""
