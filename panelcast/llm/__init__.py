"""Training-data operators: mixing, fingerprints, deduplication, tokenisation, formatting, screening."""
