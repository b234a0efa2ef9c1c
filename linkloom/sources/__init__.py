"""Scans: payload parsers, stored tables, and story data derived from driver tables."""
