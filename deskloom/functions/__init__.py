"""Column expressions: working time, buckets, text signals."""
