"""Analytics over business-conversation records, declared as Spark DataFrames."""

__version__ = "0.1.0"
