"""Training-data operators: scoring, mixing, filters, scans and near-duplicate search."""
