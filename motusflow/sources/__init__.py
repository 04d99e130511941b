"""Readers, writers and the adapter views over the generic test tables."""
