"""Training-data operators: search, URL filters, deduplication, quality, mixing and sharding."""
