"""Column functions: no I/O, no shuffles."""
