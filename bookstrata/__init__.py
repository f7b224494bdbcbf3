"""Order-book stream analytics as Spark DataFrame and Structured Streaming operators."""

__all__ = ["functions", "operators", "plans", "schemas", "session", "sources", "streaming"]
