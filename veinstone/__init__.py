"""Content-addressed provenance and analytics on Spark DataFrames."""
