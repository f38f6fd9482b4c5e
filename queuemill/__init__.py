"""queuemill: batched model inference and request analytics as Spark DataFrame operators."""

from queuemill.session import get_session

__all__ = ["get_session"]
