"""leafmill: document-intelligence analytics as PySpark DataFrame operators."""

from leafmill.session import get_spark

__all__ = ["get_spark"]
