"""Operators beside the query language: statistics and checksums."""
