"""Path normalisation: raw, without query and fragment, or with id segments collapsed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark.functions.patterns import ID_BODY, ID_SEGMENT, PATH_ONLY

RAW, STRIP_QUERY, COLLAPSE_IDS = "raw", "strip_query", "collapse_ids"
MODES = (RAW, STRIP_QUERY, COLLAPSE_IDS)


def is_object_id(segment: Column) -> Column:
    return segment.rlike(r"\A[0-9a-fA-F]{24}\z")


def is_long_numeric(segment: Column) -> Column:
    return segment.rlike(r"\A[0-9]{6,}\z")


def is_uuid(segment: Column) -> Column:
    return segment.rlike(r"\A[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z")


def is_pr_id(segment: Column) -> Column:
    return segment.rlike(r"\A[Pp][Rr]-[A-Za-z]{3,}-[0-9]{8,}\z")


def is_code_id(segment: Column) -> Column:
    return segment.rlike(r"\A[A-Za-z]{2,}-[A-Za-z]{2,}-[0-9]{6,}\z")


def is_id(segment: Column) -> Column:
    """Any of the above; purchase ids are code ids."""
    return segment.rlike(ID_SEGMENT)


def strip_query(path: Column) -> Column:
    return F.regexp_extract(path, PATH_ONLY, 0)


def normalize_path(path: Column, mode: str = COLLAPSE_IDS) -> Column:
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == RAW:
        return path
    bare = strip_query(path)
    if mode == STRIP_QUERY:
        return bare
    # One pass of one pattern; neighbours are looked at, not consumed, so successive ids are all found.
    return F.regexp_replace(bare, rf"(?<![^/])(?:{ID_BODY})(?![^/])", ":id")
