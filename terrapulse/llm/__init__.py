"""Training-data operators: quality, dedup, licences, PII, search, mixing, packing."""
