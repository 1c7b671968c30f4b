"""Scans as a stream: running summaries, and changes against the scan before with state per specimen."""
