"""A single-table analytics engine expressed in PySpark DataFrames."""
