"""weftgraph: a Spark-first engine that turns tables and documents into a clean knowledge graph."""

__version__ = "0.1.0"
