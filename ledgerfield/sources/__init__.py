"""Readers, sinks, catalog and audit helpers."""
