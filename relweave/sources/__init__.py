"""Readers, writers and schema inference."""
