"""marquee: a Spark-native engine for a movie catalogue, its vector search and
its recommendation data work, written as DataFrame / SQL / Structured
Streaming jobs."""

__version__ = "0.1.0"
