"""Periplus: vessel-trajectory analytics on PySpark DataFrames."""
