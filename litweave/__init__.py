"""litweave: record linkage and evidence screening over bibliographic exports, on Spark DataFrames."""

__version__ = "0.1.0"
