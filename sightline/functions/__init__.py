"""Sightline: functions."""
