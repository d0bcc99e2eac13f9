"""Sequence and assembly-graph analytics on PySpark."""
