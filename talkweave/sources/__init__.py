"""Readers and writers: files, change detection, atomic layers, merges."""
