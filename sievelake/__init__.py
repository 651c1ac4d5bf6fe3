"""Content hygiene and provenance analytics on Spark DataFrames."""
