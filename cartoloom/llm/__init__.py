"""Training-data operators: deduplication, classification, sharding, mixing, search and token output."""
