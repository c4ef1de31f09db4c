"""Spark-first analytics over linked notes, documents, tags, graphs and vectors."""
