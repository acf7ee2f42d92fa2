"""Training-data operators: fingerprints, sharding, deduplication, tokens, language, mixing."""
