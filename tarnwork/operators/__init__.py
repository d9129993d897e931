"""Operators over DataFrames: dependencies, lexical and dense retrieval, configuration checks, reports and statistics."""
