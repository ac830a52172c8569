"""Whole jobs and what they share."""
