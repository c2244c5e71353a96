"""Lodestar: a Spark-first engine for search, browse, recommendation and preparation of media catalogues."""
