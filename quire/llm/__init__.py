"""Training-data operators: URL filters, near-dedup, decontamination, sharding, quality, LM scoring, token output, mixing, HTML, fingerprints."""
