"""Typed property graphs, rules and question workloads as PySpark DataFrames."""
