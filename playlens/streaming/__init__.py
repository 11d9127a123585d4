"""Continuously refreshed versions of the batch operators."""
