"""Readers, writers and the adapter that shapes the shared tables into card transactions."""
