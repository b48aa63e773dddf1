"""Indicators."""
