"""A document-library analytics engine on Spark DataFrames."""
