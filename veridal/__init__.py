"""Annotation analytics as DataFrame functions."""
