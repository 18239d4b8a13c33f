"""Column functions on raw lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark.functions.patterns import CSI

ESC = "\x1b"


def strip_cr(line: Column) -> Column:
    """Without one trailing carriage return."""
    return F.when(line.endswith("\r"), F.regexp_replace(line, r"\r\z", "")).otherwise(line)


def ansi_as_space(line: Column, space: str = " ") -> Column:
    """Each terminal code becomes a blank, as between tokens."""
    return F.when(line.contains(ESC), F.regexp_replace(line, CSI, space)).otherwise(line)


def strip_ansi(text: Column) -> Column:
    """Without terminal codes, as in text that is shown."""
    return F.when(text.contains(ESC), F.regexp_replace(text, CSI, "")).otherwise(text)


def utf8_lossy(text: Column) -> Column:
    """Invalid bytes become U+FFFD."""
    return F.make_valid_utf8(text)
