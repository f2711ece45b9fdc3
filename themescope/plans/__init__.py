"""Whole steps, composed from operators."""
