"""Training-data pipeline operators (mixing, sharding, toxicity, PII, packing, dedup, quality)."""
