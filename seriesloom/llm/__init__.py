"""Training-data operators: dedup, token formats, personal data, quality, mixing and URL filters."""
