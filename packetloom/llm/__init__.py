"""Training-data operators: deduplication, filters, packing and token counts."""
