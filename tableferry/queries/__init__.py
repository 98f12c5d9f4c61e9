"""Registered queries; importing this package fills the registry."""

from . import measurements, planning, runlogs, stages, transfers  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
