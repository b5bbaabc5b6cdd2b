"""Sensitive-span analytics over corpora of documents, as Spark DataFrames."""
