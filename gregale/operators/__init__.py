"""Similarity, clustering, dedup, search and attribution operators."""
