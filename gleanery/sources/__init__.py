"""Gleanery sources."""
