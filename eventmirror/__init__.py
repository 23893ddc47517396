"""Batch and streaming jobs that keep a current-state mirror of a billing account and prove it right."""
