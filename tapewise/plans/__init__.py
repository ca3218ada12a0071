"""Named queries over the given tables, the adaptors that shape them, and their SQL oracles."""

from . import ingest, series, trading   # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
