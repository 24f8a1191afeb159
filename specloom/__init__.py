"""A Spark-first engine for indexed specification corpora: property graph, vectors, retrieval, upkeep."""

__version__ = "0.1.0"
