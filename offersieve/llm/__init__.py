"""Training-data operators: dedup, language ID, quality, tokens, sharding, PII."""
