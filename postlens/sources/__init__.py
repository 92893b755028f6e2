"""Readers, writers and the raw → post projection."""
