"""Gleanery operators."""
