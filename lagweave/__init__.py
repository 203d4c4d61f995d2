"""Spark-first analytics of directed information flow between time series."""
