"""upslope: development analytics on Spark DataFrames.

Operators take DataFrames and column names and return DataFrames; Catalyst
chooses the physical plan.  Nothing here holds data on the driver beyond
results whose size is bounded by a parameter.
"""

__version__ = "0.1.0"
