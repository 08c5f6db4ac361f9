"""quire: a Spark-first engine for document analytics (see README.md)."""

__version__ = "0.1.0"
