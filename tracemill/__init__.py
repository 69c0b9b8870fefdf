"""tracemill: a Spark-first engine for verifiable-reasoning data."""

__version__ = "0.1.0"
