"""Subpackage of the site-counting engine."""
