"""Readers that turn files into the canonical tables."""
