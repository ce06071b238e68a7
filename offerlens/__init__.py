"""Spark-first analytics over evidence-carrying product campaigns."""
