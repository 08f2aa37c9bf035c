"""Scans of text files, JSON lines and feeds, and append, patch and overwrite sinks."""
