"""Whole jobs built from operators."""
