"""Panels and plan macros."""
