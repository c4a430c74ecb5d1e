"""Readers and writers: articles, run logs, event logs, Kafka, models."""
