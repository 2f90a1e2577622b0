"""Training-data operators: tokenising, deduplication, search, scans and archives."""
