"""Sightline: sources."""
