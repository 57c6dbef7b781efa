"""Boundary tables and files."""
