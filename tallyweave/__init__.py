"""Count-table analytics on Spark: long (sample, feature, count) tables in, DataFrames out."""

from tallyweave.countset import CountSet

__all__ = ["CountSet"]
