"""corpusgraph: corpus tables in, graph tables out — on Spark DataFrames."""

__version__ = "0.1.0"
