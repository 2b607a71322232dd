"""Readers and writers: the lake, raw lines, file inventories, session files."""
