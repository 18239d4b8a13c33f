"""Vector codes, the positional index and the prefix trie: against SQL, brute force, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm import positional_index as pi
from logspark.llm import prefix_trie, queries, vector_codes

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "conversations", "embeddings")


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_decontamination", "op13_prefix_trie"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found, sql = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == sorted(sql.columns)
    want = sql.select(*found.columns).fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


# --- 11 ----------------------------------------------------------------------


def plain_lloyd(vectors, parts, entries, rounds):
    """Every part scans its whole codebook, in Python's integers."""
    x = [[[int(np.floor(256 * np.float64(v))) for v in vec[p * len(vec) // parts : (p + 1) * len(vec) // parts]] for p in range(parts)] for vec in vectors]
    books = [[row[p] for row in x[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(row[p], c, strict=True)), e) for e, c in enumerate(books[p])) for p in range(parts)] for row in x]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [row[p] for row, f in zip(x, found, strict=True) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    return [("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for f in found], ",".join(str(v) for b in books for c in b for v in c)


def rows_of_vectors(seed, n, big=False):
    r = random.Random(seed)
    rows = [[r.choice([-0.5, 0.0, 0.25, r.uniform(-1, 1)]) for _ in range(8)] for _ in range(n)]
    if big:
        rows[3], rows[5], rows[n - 1] = [1e30] * 8, [-3e38, *[0.5] * 7], [2.0**40] * 8
    return rows


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("rounds", [2, 5])
def test_active_entries_give_what_whole_scans_give(spark, big, rounds):
    vectors = rows_of_vectors(3, 120, big)
    vectors = [[float(np.float32(v)) for v in vec] for vec in vectors]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(5)
    coded = vector_codes.fit(table, parts=4, entries=16, rounds=rounds)
    want, books = plain_lloyd(vectors, 4, 16, rounds)
    got = {r["id"]: (r["codes"].hex(), r["error"]) for r in coded.rows.collect()}
    assert [got[k] for k in range(len(vectors))] == [(c, min(e, 2**63 - 1)) for c, e in want]
    assert vector_codes.digest(coded.books) == hashlib.sha256(books.encode()).hexdigest()


def test_rescan_ties_go_to_the_lower_index():
    x = np.array([[0], [4]])
    code, distance = vector_codes.rescan(x, np.array([[2], [9], [-2]]), np.array([True, False, True]), np.array([1, 1]), np.array([81, 25]))
    assert (code.tolist(), distance.tolist()) == ([0, 0], [4, 4])
    # Entry 2 comes as near as entry 1, which stays; entry 0 as near and lower, which wins.
    code, _ = vector_codes.rescan(np.array([[0]]), np.array([[9], [3], [-3]]), np.array([False, False, True]), np.array([1]), np.array([9]))
    assert code.tolist() == [1]
    code, _ = vector_codes.rescan(np.array([[0]]), np.array([[-3], [3], [9]]), np.array([True, False, False]), np.array([1]), np.array([9]))
    assert code.tolist() == [0]


def test_vectors_odd(spark):
    good = [0.5] * 16
    rows = [(1, None, 1), (2, [None, *good[1:]], 1), (3, [float("nan"), *good[1:]], 1), (4, [float("inf"), *good[1:]], 1), (5, [], 1), (6, good, None), (7, [0.25] * 16, None), (None, good, 2), (7, good, 3), (8, [1.0] * 32, 1)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, id string, codes string")
    coded = vector_codes.fit(table, label_col="label")
    for few in (0, 100):
        found = vector_codes.with_label_error(coded.rows, few).collect()
        assert sorted((r["id"] or -1, r["label"] or -1, r["error"], r["label_error"]) for r in found) == [(-1, 2, 0, 0), (6, -1, 0, 0), (7, -1, 0, 0), (7, 3, 0, 0)]
    assert len(coded.books[0]) == 4
    none = vector_codes.fit(table.where("vec_id = 1"), label_col="label")
    assert vector_codes.with_label_error(none.rows).collect() == [] and none.books == []


def test_reconstruct(spark):
    table = spark.createDataFrame([(k, [k / 4.0] * 16) for k in range(3)], "vec_id long, embedding array<double>")
    coded = vector_codes.fit(table)
    for r in coded.rows.select("vector", vector_codes.reconstruct(F.col("codes"), coded.books).alias("near")).collect():
        assert max(abs(a - b) for a, b in zip(r["vector"], r["near"], strict=True)) <= 1 / 256


# --- 12 ----------------------------------------------------------------------

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, window, slop):
    grams = {}
    for name, text in items:
        w = plain_words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + window]), set()).add("null" if name is None else str(name))
    out = []
    for d, text in docs:
        w, hit, exact, near = plain_words(text), set(), set(), set()
        for g, names in grams.items():
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    exact |= names
                if all(t in w[max(0, s + k - slop) : s + k + slop + 1] for k, t in enumerate(g)):
                    near |= names
        out.append((d, len(w), len(hit), sorted(exact), sorted(near) if slop else []))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard, block, window, slop", [(1 << 20, 10**6, 4, 1), (40, 10**6, 4, 2), (40, 5, 3, 1), (200, 1, 10, 0)])
def test_phrases_and_proximity(spark, monkeypatch, shard, block, window, slop):
    """Small shards cut texts in pieces, small blocks ask in parts, few words make many candidates."""
    monkeypatch.setattr(pi, "SHARD_BYTES", shard)
    monkeypatch.setattr(pi, "MOST_CANDIDATES", 50)
    r = random.Random(11)
    vocabulary = ["a", "B", "cc", "d9", "É", "日本", "ff"]
    docs = [(k, r.choice(" .\n-").join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 30, 250])))) for k in range(30)]
    docs += [(5, docs[4][1]), (None, "a B cc d9 É"), (99, None), (98, ""), (97, "..."), (96, "x" * 500)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 5, 12])))) for k in range(12)] + [(3, "cc d9"), (None, "ff ff"), (50, None), (51, "!"), (52, "nowhere a")]
    table = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, rows int, id string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = pi.search(pi.build(table), asked, window=window, slop=slop, block_words=block)
    got = sorted(((x["doc_id"], x["n_words"], x["n_hit"], x["items"], x["near_items"]) for x in found.collect()), key=repr)
    assert got == plain_search(docs, items, window, slop)


def test_index_edges(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in pi.search(pi.build(docs), nothing).collect()] == [(3, 0, [])]
    items = spark.createDataFrame([("q", "two three")], "item_id string, text string")
    assert pi.search(pi.build(docs.where("doc_id < 0")), items).collect() == []
    row = pi.search(pi.build(docs), items).first()
    assert [tuple(s) for s in row["spans"]] == [(1, 3)] and row["items"] == ["q"]
    with pytest.raises(ValueError):
        pi.search(pi.build(docs), items, window=100)


def test_very_long_text(spark):
    """A text of several pieces: a passage over each possible cut is found, words are counted once."""
    words = [f"w{k}" for k in range(300_000)]
    items = [(k, " ".join(words[k : k + 14])) for k in range(1000, 300_000, 7001)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = pi.search(pi.build(docs), spark.createDataFrame(items, "item_id long, text string")).first()
    assert (row["n_words"], row["n_hit"], row["n_items"]) == (300_000, 14 * len(items), len(items))


# --- 13 ----------------------------------------------------------------------


def plain_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids, below = {}, {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            a = below.setdefault(p[:d], [0, 0])
            a[0] += saved
            a[1] += p not in kids
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p)))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), below[p][1], below[p][0], sha(p)) for p, m in members.items()), key=repr)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, key string")


def found_trie(spark, rows, parts=4):
    return sorted(map(tuple, prefix_trie.build(conversations(spark, rows).repartition(parts)).collect()), key=repr)


def test_trie_odd(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["u", "a", None]), r.choice(["hi there", "hi  there", "", None, "x\ty"])) for c in range(60) for t in range(r.randrange(1, 7)) if c % 7]
    rows += [(20, None, "s", "no turn"), (20, None, "s", "no turn"), (20, 1, "u", "again"), (20, 1, "u", "again"), (None, 1, "u", "no conversation"), (10**15, 0, "u", "far"), (43, 5, "ab", "c"), (44, 5, "a", "bc")]
    assert found_trie(spark, rows) == plain_trie(rows)


def test_trie_of_one_turn_and_none(spark):
    rows = [(c, 0, "u", "only") for c in range(25, 40)]  # no conversation 20: all turns of some are left out
    assert found_trie(spark, rows) == plain_trie(rows)
    assert prefix_trie.build(conversations(spark, rows).where("conv_id < 0")).collect() == []


def test_trie_deep_and_wide(spark, monkeypatch):
    """A conversation of a third of all rows, copies of one another, very many children of one node."""
    monkeypatch.setattr(prefix_trie, "MANY_CHILDREN", 10)
    monkeypatch.setattr(prefix_trie, "PACKED", 100)
    deep = [(0, t, "u", f"t{t % 9} word") for t in range(150)]
    copies = [(c, t, "a", f"same {t}") for c in range(100, 140) for t in range(3)]
    wide = [(c, t, "a", "first" if t == 0 else f"own {c}") for c in range(200, 240) for t in range(2)]
    rows = list(itertools.chain(deep, copies, wide))
    assert found_trie(spark, rows, 6) == plain_trie(rows)
