"""Operators of a training-data pipeline; ``lumeset.llm.catalog`` registers their queries."""
