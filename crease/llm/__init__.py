"""Training-data operators (language ID, near-duplicate search, packing, sharding, tokenising)."""
