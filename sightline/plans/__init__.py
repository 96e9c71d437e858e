"""Sightline: plans."""
