"""Spark-first analytics for listener-state time series, with operators for text corpora."""
