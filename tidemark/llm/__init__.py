"""Training-data operators: media, deduplication, packing, scanning, scoring and extraction."""
