"""tonearm: music-library analytics as Spark DataFrame transformations."""

from tonearm.session import build_session

__all__ = ["build_session"]
