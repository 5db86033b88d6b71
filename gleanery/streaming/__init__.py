"""Gleanery streaming."""
