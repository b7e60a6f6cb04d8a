"""Vulnerability-intelligence analytics as Spark jobs.

Feeds, merges, retrieval, crawl work queue and reports are DataFrame
transformations; nothing here talks to a network or a model.
"""
