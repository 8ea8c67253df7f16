"""Operators of a training-data pipeline: deduplication, scanning, scoring and tokenisation."""
