"""Training-data operators: fingerprints, quality, deduplication, archives,
mixing, licence scans, token encoding, vector search and token files.

Nothing else in the library imports this subpackage. Each module holds one
operator with its general interface; ``queries`` holds the thin registered
queries that derive the result columns from them."""
