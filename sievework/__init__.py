"""Catalogue curation, requirement matching and corpus preparation on PySpark DataFrames."""
