"""cairnflow: repeatable analytical workflows as Spark DataFrames."""

__version__ = "0.1.0"
