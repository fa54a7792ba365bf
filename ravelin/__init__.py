"""Ravelin: a Spark-first engine for time-series strategy research and corpus preparation."""
