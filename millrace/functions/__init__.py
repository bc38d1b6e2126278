"""Typed scalar expressions and their Spark columns."""
