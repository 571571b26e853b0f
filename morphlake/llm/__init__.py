"""Training-data operators: scoring, deduplication, filtering, counting and packing of documents."""
