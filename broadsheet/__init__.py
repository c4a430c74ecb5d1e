"""Broadsheet: news-text analytics as Spark DataFrame, streaming and ML jobs."""
