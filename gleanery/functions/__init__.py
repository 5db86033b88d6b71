"""Gleanery functions."""
