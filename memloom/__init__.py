"""Spark jobs for building, ranking, packing and certifying conversational memory at scale."""
