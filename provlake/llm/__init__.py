"""Training-data operators: quality, language-model scoring, deduplication, privacy, packing."""
