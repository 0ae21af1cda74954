"""quarry: document preparation and retrieval operators on Spark DataFrames."""

__version__ = "0.1.0"
