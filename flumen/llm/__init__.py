"""Training-data operators: ten document operators built on Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
