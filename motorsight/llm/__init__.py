"""Operators of a large-scale training-data pipeline, on Spark DataFrames.

Each module holds one operator with a general interface; ``queries`` registers the
thin ``opN_<name>`` queries that apply them to whole tables.
"""
