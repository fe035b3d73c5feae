"""Seqloom functions."""
