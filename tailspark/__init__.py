"""Equity tail-risk analytics as Spark DataFrame jobs."""

from tailspark.config import FEATURES, SchemaError, Settings
from tailspark.session import build_session

__all__ = ["FEATURES", "SchemaError", "Settings", "build_session"]
