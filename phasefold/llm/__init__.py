"""Training-data operators: deduplication, mixing, quality, tokens, scoring, archives, packing, chat."""
