"""Readers of landed data, source tables, board adapters and the posting store."""
