"""Landed feed pages and stored tables."""
