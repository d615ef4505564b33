"""Readers of raw files and the forecast store."""
