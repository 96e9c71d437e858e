"""Sightline: streaming."""
