"""Operators for preparing large text corpora (training data) on Spark.

Every operator takes DataFrames and returns DataFrames.  Nothing outside this
folder imports it; ``queries`` holds the registered queries.
"""
