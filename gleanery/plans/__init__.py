"""Gleanery plans."""
