"""Training-data operators: deduplication, filtering, tokens and archives."""
