"""Retrieval analytics on Spark: dependency cards, lexical and dense retrieval, ranking scores, guards and paired statistics."""
