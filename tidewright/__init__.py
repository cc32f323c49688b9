"""tidewright: timeline and dialogue analytics on Spark DataFrames."""

from tidewright.session import build_session, table

__all__ = ["build_session", "table"]
