"""tidemark: approximate and exact analytics over batch and streaming DataFrames, Spark first."""

__version__ = "0.1.0"
