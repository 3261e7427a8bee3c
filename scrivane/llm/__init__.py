"""Training-data operators: counting, segmenting, formatting, filtering, deduplicating, mixing and archiving text corpora."""
