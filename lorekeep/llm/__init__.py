"""Training-data operators: quality, deduplication, privacy, packing, tokenising."""
