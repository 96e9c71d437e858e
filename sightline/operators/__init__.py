"""Sightline: operators."""
