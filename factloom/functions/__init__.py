"""Column functions: no I/O, no joins."""
