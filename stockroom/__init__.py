"""Catalogue routing and page enrichment as Spark jobs."""
