"""Seqloom plans."""
