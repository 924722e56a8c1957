"""Operators over event tables: combining, dimensions, rollups, enrichment."""
