"""Fingerprints: sketches against a plain version, neighbours over hot and missing ids, merging as an aggregate."""

import collections
import random
import re

import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from logspark.llm import fingerprints as fp
from logspark.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def plain_sketch(text, k=fp.K, n=fp.WORDS):
    w = [x.encode() for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    shingles = [w[i : i + n] for i in range(len(w) - n + 1)] if len(w) >= n else [[b" ".join(w)]] if w else []
    found = set()
    for shingle in shingles:
        h = 42
        for word in shingle:
            h = xxhash.xxh64_intdigest(word, seed=h)
        found.add(signed(h))
    return sorted(found)[:k]


def plain_likeness(a, b, k=fp.K):
    if not a or not b:
        return float(not a and not b)
    union = sorted({*a, *b})
    seen = union if len(a) < k and len(b) < k else union[:k]
    return len([x for x in seen if x in set(a) and x in set(b)]) / len(seen)


def test_query_equals_plain_version(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    table = dict(zip(t["doc_id"], [x or "" for x in t["text"]], strict=True))
    rows = {r["doc_id"]: r for r in queries.op2_fingerprints(spark, SF).collect()}
    ids = sorted(table, reverse=True)
    assert len(rows) == len(ids)
    for place, d in enumerate(ids):
        text, after = table[d], table[ids[(place + 1) % len(ids)]]
        changed = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        own, edited, follower = plain_sketch(text), plain_sketch(changed), plain_sketch(after)
        r = rows[d]
        assert r["fingerprint"] == "".join(f"{x % 2**64:016X}" for x in own)
        assert r["edited_fingerprint"] == "".join(f"{x % 2**64:016X}" for x in edited)
        assert abs(r["near_edited"] - plain_likeness(own, edited)) < 1e-12
        assert abs(r["near_next"] - plain_likeness(own, follower)) < 1e-12
        assert 0 <= r["in_edited"] <= 1 and 0 <= r["in_next"] <= 1
    by_text = collections.defaultdict(set)
    for d, r in rows.items():
        by_text[table[d]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values()) and len(by_text) < len(table)


@pytest.fixture(scope="module")
def repeated(spark):
    """A third of the rows without an id, a third of one id, some rows of one id and text, least and largest ids."""
    rows = [(None, f"none {k}") for k in range(60)] + [(5, f"five {k}") for k in range(60)] + [(9, "copy")] * 70 + [(3, "three")] * 2
    rows += [(k, f"own {k}") for k in range(10, 60)] + [(-(2**63), "least"), (2**63 - 1, "most"), (None, None)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize(("rows_a_range", "hot"), [(1, 1000), (3, 1000), (3, 20), (1000, 1), (None, 1000)])
def test_next_over_repeated_and_missing_ids(repeated, monkeypatch, rows_a_range, hot):
    docs, rows = repeated
    monkeypatch.setattr(fp, "COPIES", 8)
    found = fp.with_next(docs, rows_a_range=rows_a_range, hot=hot).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in found) == collections.Counter((k, t or "") for k, t in rows)
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], signed(xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42))), reverse=True)
    following = [order[(k + 1) % len(order)][1] or "" for k in range(len(order))]
    expected = collections.Counter((key, text or "", after) for (key, text), after in zip(order, following, strict=True))
    assert collections.Counter((r["doc_id"], r["text"], r["next_text"]) for r in found) == expected
    assert all(r["sketch"] == plain_sketch(r["text"]) and r["next_sketch"] == plain_sketch(r["next_text"]) for r in found)


def test_ranges_follow_the_rows_and_split_hot_ids(repeated, spark):
    keys = repeated[0].select(F.coalesce("doc_id", F.lit(fp.LEAST)).alias("_k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t")).distinct()
    n = keys.count()
    borders = fp._borders(keys, n, n // 4)
    assert n // 6 < len(borders) < n // 3 and borders == sorted(set(borders))
    assert len([b for b in borders if b[0] == 5]) > 5 and len([b for b in borders if b[0] == fp.LEAST]) > 5
    assert fp._borders(keys, n, 1) == []


def test_merged_parts_are_the_whole(spark):
    rng = random.Random(1)
    words = [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(3000)]
    rows = []
    for key in ("one", "two", None):
        own = words[: 3000 if key == "one" else 900]
        rows += [(key, " ".join(own[k : k + 100 + fp.WORDS - 1])) for k in range(0, len(own), 100)] * 2
    rows += [("empty", ""), ("empty", None), ("short", "a b"), ("short", "")]
    parts = spark.createDataFrame(rows, "key string, text string").withColumn("sketch", fp.sketch(F.col("text")))
    merged = fp.merged(parts, "key")
    found = {r["key"]: r["sketch"] for r in merged.collect()}
    assert found["empty"] == [] and found["short"] == plain_sketch("a b")
    for key, n in (("one", 3000), ("two", 900), (None, 900)):
        assert found[key] == plain_sketch(" ".join(words[:n]))
    assert merged.count() == 5 and "WindowGroupLimit" in merged._jdf.queryExecution().executedPlan().toString()
    assert fp.merged(parts.where("false"), "key").count() == 0


def test_one_very_long_text(spark):
    words = [f"w{k}" for k in range(60_000)]
    text = " ".join(words)
    row = fp.edited(fp.with_next(spark.createDataFrame([(1, text), (2, text[::-1])], "doc_id long, text string"))).where("doc_id = 1").first()
    assert row["sketch"] == plain_sketch(text) and row["near_next"] == 0.0
