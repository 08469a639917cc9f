"""Training-data operators: deduplication, filtering, scoring and packing of large text corpora."""
