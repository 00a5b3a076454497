"""Training-data operators: cleaning, deduplication, search, mixing and packing."""
