"""Requests, their validation, and the DataFrames they become."""
