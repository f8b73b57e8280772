"""Spark-first jobs for speech transcripts, plus training-data operators in ``voxloom.llm``."""
