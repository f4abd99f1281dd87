"""Whole queries composed from operators, with their oracle SQL."""
