"""Cairn: a compressed, randomly readable store of documents, planned as Spark DataFrames."""
