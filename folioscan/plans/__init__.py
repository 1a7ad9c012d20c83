"""Analyses made of several operators."""
