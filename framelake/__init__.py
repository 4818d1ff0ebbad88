"""Framelake: block-coded media and fixed-rate signals as Spark DataFrames."""
