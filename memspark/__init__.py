"""Batch and streaming operators over agent memories, documents and events, written for Spark DataFrames."""
