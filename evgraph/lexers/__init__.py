"""Per-file helpers that turn source text into facts; what facts mean together is decided by joins."""
