"""Window analytics for classified DNA sequences, as Spark DataFrame operators."""

__version__ = "0.1.0"
