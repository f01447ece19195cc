"""Exact weighted genotype scoring, and corpus preparation, as Spark plans."""
