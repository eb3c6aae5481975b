"""Training-data operators: chat records, tokens, neighbours, mixing, packing and filters."""
