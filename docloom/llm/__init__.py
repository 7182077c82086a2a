"""Training-data operators: thirteen corpus-preparation jobs that run on Spark.

Nothing outside this package imports it.
"""
