"""Protein-structure similarity data jobs on Spark DataFrames."""
