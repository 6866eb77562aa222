"""Security analytics as PySpark DataFrames: detection, cases, intel, behaviour."""

from watchkeep.session import session

__all__ = ["session"]
