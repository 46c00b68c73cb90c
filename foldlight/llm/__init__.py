"""Training-data operators: quality, URL policy, dedup, decontamination, mixing, tokens."""
