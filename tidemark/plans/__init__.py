"""Query definitions and their registry."""
