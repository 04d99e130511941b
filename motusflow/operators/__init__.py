"""Relational and signal operators over sensor, annotation and session tables."""
