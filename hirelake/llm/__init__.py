"""Training-data operators: quality, deduplication, safety, decontamination, language models, sharding, tokens."""
