"""Readers, writers and stored stages."""
