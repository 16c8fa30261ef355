"""Lodestack: document retrieval, context assembly and corpus preparation as lazy Spark DataFrames."""
