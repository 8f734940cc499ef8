"""lectern: a Spark-first engine that audits the structure and accessibility of documents at scale."""

__version__ = "0.1.0"
