"""Trace, log and metric analytics on Spark, plus training-data operators in ``llm``."""
