"""Readers and writers: object tables, records, nested files, volumes, registries."""
