"""Annotated-text analytics on PySpark DataFrames."""
