"""Quad analytics on Spark: labelled RDF-style statements as DataFrames."""
