"""Seqloom sources."""
