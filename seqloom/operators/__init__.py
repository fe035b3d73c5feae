"""Seqloom operators."""
