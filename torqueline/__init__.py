"""Spark jobs for maintenance-knowledge data: corpus, retrieval, graph, lifecycle, usage and evaluation."""
