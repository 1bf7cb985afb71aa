"""Training-data operators: near-dedup, mixing, secrets, packing, token files, language, quality, licenses."""
