"""Typed graphs from files and tables."""
