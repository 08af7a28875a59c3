"""Batch retrieval, chunking and compliance scoring as Spark DataFrame operators."""
