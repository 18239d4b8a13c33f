import pytest
from pyspark.sql import functions as F

from logspark.functions import paths

CASES = {
    "/api/users/507f1f77bcf86cd799439011/profile": "/api/users/:id/profile",
    "/api/v1/health": "/api/v1/health",
    "/api/v1/users/2": "/api/v1/users/2",
    "/api/v1/users/1234567": "/api/v1/users/:id",
    "/a/1234567/7654321/?x=1": "/a/:id/:id/",
    "/pr-abc-12345678": "/:id",
    "/o/AB-CD-123456#z": "/o/:id",
    "/u/123e4567-e89b-12d3-a456-426614174000": "/u/:id",
    "/a//": "/a//",
    "": "",
}


def test_collapse(spark):
    rows = spark.createDataFrame([(p,) for p in CASES], "p string")
    got = {r[0]: r[1] for r in rows.select("p", paths.normalize_path(F.col("p"))).collect()}
    assert got == CASES


def test_strip_and_raw(spark):
    row = spark.createDataFrame([("/api/x?foo=1&bar=2",)], "p string").select(paths.normalize_path(F.col("p"), "strip_query"), paths.normalize_path(F.col("p"), "raw")).first()
    assert tuple(row) == ("/api/x", "/api/x?foo=1&bar=2")
    with pytest.raises(ValueError):
        paths.normalize_path(F.lit("x"), "other")


def test_detectors(spark):
    tests = {"PR-abc-12345678": paths.is_pr_id, "ab-cd-123456": paths.is_code_id, "123456": paths.is_long_numeric, "a" * 24: paths.is_object_id}
    rows = spark.createDataFrame([(s,) for s in [*tests, "PR-ab-1", "x"]], "s string")
    for text, test in tests.items():
        assert [r[0] for r in rows.where(test(F.col("s"))).collect() if r[0] == text] == [text]
        assert not rows.where(test(F.col("s"))).where(F.col("s").isin("PR-ab-1", "x")).count()
