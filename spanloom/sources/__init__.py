"""Readers, writers and adapters of tables."""
