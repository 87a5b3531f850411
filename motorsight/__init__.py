"""motorsight: predictive-maintenance operators on Spark DataFrames.

Every operator is a function from DataFrame to DataFrame built on Spark SQL,
Spark ML and Structured Streaming.
"""

__version__ = "0.1.0"
