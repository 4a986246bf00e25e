"""Training-data operators: deduplication, tokenisation, packing, fingerprints, PII, quality, vector search.

Nothing outside this subpackage imports it; ``queries`` and ``oracles`` hold what the driver contract registers.
"""
