"""Training-data operators: deduplication, filters, tokens, decontamination, search, models."""
