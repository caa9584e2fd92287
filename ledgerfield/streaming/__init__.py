"""Windowed monitoring."""
