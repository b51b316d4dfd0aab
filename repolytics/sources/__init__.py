"""Readers, writers and shapes built from plain tables."""
