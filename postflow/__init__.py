"""postflow: a posting-table engine on Spark DataFrames."""

__version__ = "0.1.0"
