"""Spark-first selection, scoring and corpus-preparation operators."""
