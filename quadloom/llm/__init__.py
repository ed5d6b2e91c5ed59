"""Training-data operators: sharding, filtering, mixing, deduplication, tokenising and scoring of text corpora."""
