"""Building-safety analytics on Spark DataFrames.

Every operator takes DataFrames and explicit parameters (the date of
calculation included) and returns a DataFrame covering all entities at once.
"""
