"""Whole-table transfers between storage formats, and analysis of how they performed, on Spark."""

from .schema import Attribute, cut_to_schema, enforce_schema, schema_from_json, struct_of
from .session import build_session, scratch, work_dir

__all__ = [
    "Attribute",
    "build_session",
    "cut_to_schema",
    "enforce_schema",
    "schema_from_json",
    "scratch",
    "struct_of",
    "work_dir",
]
