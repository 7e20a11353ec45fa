"""Training-data operators on Spark DataFrames.

Nothing outside this folder imports it. Each module holds one operator with a
general interface; ``queries`` holds the thin digests registered as queries.
"""
