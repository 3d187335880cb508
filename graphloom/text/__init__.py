"""Normalising, tokenising and linking text."""
