"""Structured Streaming jobs: clean, score, route, de-duplicate."""
