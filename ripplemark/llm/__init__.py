"""Training-data operators (deduplication, scoring, mixing, tokenising)."""
