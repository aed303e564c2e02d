"""Corpus analytics on Spark: browse, retrieval, graph, claims, curation, identity and telemetry jobs."""
