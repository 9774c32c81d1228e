"""tidemark: change-log and log-archive analytics on Spark DataFrames."""

__version__ = "0.1.0"
