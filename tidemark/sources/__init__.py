"""Readers and writers of raw logs, segments and lists."""
