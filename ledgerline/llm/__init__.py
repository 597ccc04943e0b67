"""Operators of a training-data pipeline: text, url, vector and conversation tables at corpus size."""
