"""Spark-first engine for timed tokens, intervals, nested timelines and sampled signals."""
