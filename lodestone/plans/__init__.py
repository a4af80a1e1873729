"""Portable SQL plans."""
