"""Composed plans: feature sets, preprocessing, the registered queries."""
