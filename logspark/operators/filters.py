"""Filters on HTTP requests; the defaults let everything pass."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.paths import COLLAPSE_IDS, normalize_path

ALL, SUCCESS, REDIRECT, CLIENT_ERROR, SERVER_ERROR, ERROR_ONLY = "all", "success", "redirect", "client_error", "server_error", "error_only"


def status_family(status: Column, family: str) -> Column:
    """Server errors have no upper bound."""
    return {
        ALL: lambda: F.lit(True),
        SUCCESS: lambda: status.between(200, 299),
        REDIRECT: lambda: status.between(300, 399),
        CLIENT_ERROR: lambda: status.between(400, 499),
        SERVER_ERROR: lambda: status >= 500,
        ERROR_ONLY: lambda: status >= 400,
    }[family]()


@dataclass(frozen=True)
class FilterOptions:
    """Bounds are inclusive; search is a literal part of the normalised path, in any case of letters."""

    method: str | None = None
    status_family: str = ALL
    min_duration_ms: float = 0.0
    max_duration_ms: float | None = None
    search: str = ""
    path_mode: str = COLLAPSE_IDS

    def predicates(self) -> list[Column]:
        found = []
        if self.method:
            found.append(F.col("method") == self.method)
        if self.status_family != ALL:
            found.append(status_family(F.col("status"), self.status_family))
        if self.min_duration_ms > 0:
            found.append(F.col("duration_ms") >= F.lit(self.min_duration_ms).cast("float"))
        if self.max_duration_ms is not None:
            found.append(F.col("duration_ms") <= F.lit(self.max_duration_ms).cast("float"))
        if self.search:
            found.append(F.contains(F.lower("norm_path"), F.lower(F.lit(self.search))))
        return found


def apply_filters(requests: DataFrame, options: FilterOptions = FilterOptions()) -> DataFrame:
    """requests with norm_path by the options' mode, filtered by all predicates that say something.

    A parsed table's own norm_path, with ids collapsed, is used as it is.
    """
    known = options.path_mode == COLLAPSE_IDS and "norm_path" in requests.columns
    rows = requests if known else requests.withColumn("norm_path", normalize_path(F.col("path"), options.path_mode))
    found = options.predicates()
    return rows.where(reduce(and_, found)) if found else rows
