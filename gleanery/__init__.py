"""Gleanery: curation, exact repair and measurement of text corpora on PySpark DataFrames."""
