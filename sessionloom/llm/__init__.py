"""Training-data operators: packing, deduplication, scanning, extraction, scoring and mixing of text tables."""
