"""All registered queries."""

from . import cleaning, evaluation, modelling, pool, preparation  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
