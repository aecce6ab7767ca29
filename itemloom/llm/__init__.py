"""Training-data operators: quality, decontamination, dedup, mixing, safety, language."""
