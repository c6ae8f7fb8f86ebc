"""Readers, writers, scratch tables and row identity."""
