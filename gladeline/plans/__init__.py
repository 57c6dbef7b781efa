"""Whole jobs built from the operators: screening, serving, reports, models."""
