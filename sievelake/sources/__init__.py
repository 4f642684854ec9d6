"""Scans and sinks for text datasets."""
