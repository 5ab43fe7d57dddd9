"""heliodor: a Spark-native corpus pipeline and hybrid retrieval engine."""

from heliodor.session import get_session

__all__ = ["get_session"]
