"""Operators for large training-text pipelines.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` applies them to the shared tables and ``sql`` states the
same results for DuckDB where SQL can.
"""
