"""Training-data operators: Spark jobs that read corpora and return DataFrames.

Nothing outside this subpackage imports it.
"""
