"""Compositions of operators selected by a preset."""
