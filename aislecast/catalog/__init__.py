"""Every operator as a named query over the given tables."""

from . import basics, business, modelling, statistics  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
