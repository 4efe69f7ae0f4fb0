"""Incremental matching of new batches against the historical store."""
