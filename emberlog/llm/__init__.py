"""Training-data operators: dedup, token counting and encoding, packing, scoring, sketches and media."""
