"""Quillstone: an analytics engine whose plans are Spark DataFrames."""
