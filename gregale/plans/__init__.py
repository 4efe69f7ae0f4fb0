"""Composed plans: features, the pipeline and the registered queries."""
