"""Discovery of governing equations from tables, on Spark.

Snapshots of a field are rows with an array column; they are expanded into a dictionary of candidate
terms, and the few terms that explain a target are found from a small summary that Spark reduces
from all rows.
"""
