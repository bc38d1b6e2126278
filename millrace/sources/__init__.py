"""Catalog, bulk loading, the columnar file format, and generated data."""
