"""Seqloom streaming."""
