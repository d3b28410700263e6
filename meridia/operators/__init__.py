"""Operators over long panels."""
