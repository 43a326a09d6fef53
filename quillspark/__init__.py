"""A Spark-native engine for document retrieval and grounded question answering."""

__version__ = "0.1.0"
