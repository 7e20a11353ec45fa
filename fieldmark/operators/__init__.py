"""Statistics, cleaning and text operators over DataFrames.

Operators reduce rows to sufficient statistics in Spark (counts, moments, cross
products, rank sums, contingency counts) and finish a handful of numbers on the driver.
"""
