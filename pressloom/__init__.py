"""Spark-first operators for news evidence: merge, group, link, score, retrieve, verify."""
