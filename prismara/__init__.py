"""prismara: Spark-first organisation of large image collections and their training data."""

__version__ = "0.1.0"
