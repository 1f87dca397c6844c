"""Readers, writers and the views over the generated tables."""
