"""Training-data operators: formatting, filtering, deduplication, mixing, packing, search and output."""
