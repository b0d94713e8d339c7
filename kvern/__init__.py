"""kvern: layout analytics and training-data operators written Spark-first."""

__version__ = "0.1.0"
