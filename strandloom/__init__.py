"""Strandloom: temporal-sequence analytics expressed as Spark DataFrames."""
