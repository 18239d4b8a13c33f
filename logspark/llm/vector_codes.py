"""Vector codes: product codebooks by Lloyd's rounds that look at moved entries only.

Components become integers, floor(256 x).  A vector is cut into PARTS equal
runs, each coded by the nearest of at most ENTRIES entries of its position's
codebook (squared Euclidean distance, ties to the lower index).  Codebooks
start as the parts of the least ids and become, in each round, the floored
means of the parts assigned to them; an entry without parts stays.

Active entries: with a vector are stored each part's entry and exact distance.
A part whose entry has not moved since compares only the moved entries with
that distance (an equal distance wins with a lower index only); a part whose
entry has moved looks at the whole codebook again.  Both give what a whole
scan gives.

What is stored is one row for each vector, written to the checkpoint folder
once a round.  Sums and counts of entries are added up by Spark; the driver
holds codebooks alone, ENTRIES vectors at most.

Rows that have no code are dropped: a null vector, a null or non-finite
component, or a length other than the commonest one that PARTS divides (of two
the longer).  Null ids come last, rows of one id are ordered by their vectors.
Fewer than ENTRIES rows give as many entries; an empty table gives no rows.
Distances are exact at any size: beyond 53 bits they are Python's integers, an
error beyond 63 bits is given as 2**63 - 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm import common
from logspark.llm.components import spread_join

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Integers below this have products and sums of 512 products that a double holds exactly.
_SMALL = 1 << 21
_LIMB = 40
_MOST = (1 << 63) - 1
#: Groups of labels up to which their sums are broadcast.
FEW_LABELS = 100_000

Books = list[np.ndarray]  # for each part position: entries x components, integers


@dataclass
class Coded:
    """rows: id, label, vector, codes (a byte a part), distances (8 bytes a part, -1 beyond 62 bits), error."""

    rows: DataFrame
    books: Books


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): as 64-bit integers if they are small, else as Python's."""
    floored = np.floor(values.astype(np.float64) * SCALE)
    if not floored.size or np.abs(floored).max() < _SMALL:
        return floored.astype(np.int64)
    return np.array([int(v) if abs(v) < np.inf else SCALE * int(x) for v, x in zip(floored.ravel(), values.ravel().astype(np.float64), strict=True)], object).reshape(values.shape)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all x (rows) to all entries (columns)."""
    small = x.dtype != object and entries.dtype != object and x.shape[1] <= 512
    if small and (not entries.size or np.abs(entries).max() < _SMALL):
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return ((x.astype(object)[:, None, :] - entries.astype(object)[None, :, :]) ** 2).sum(2)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, its distance) over the whole codebook."""
    d = distances(x, entries)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def rescan(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """scan(x, entries), where code and distance are those before the entries marked in `moved` were replaced."""
    still = ~moved[code] & (distance >= 0)
    code, distance = code.copy(), distance.astype(object) if entries.dtype == object or x.dtype == object else distance.copy()
    active = np.flatnonzero(moved)
    rest = np.flatnonzero(~still)
    if len(rest):
        code[rest], distance[rest] = scan(x[rest], entries)
    fixed = np.flatnonzero(still)
    if len(active) and len(fixed):
        at, d = scan(x[fixed], entries[active])
        at = active[at]
        nearer = (d < distance[fixed]) | ((d == distance[fixed]) & (at < code[fixed]))
        code[fixed[nearer]], distance[fixed[nearer]] = at[nearer], d[nearer]
    return code, distance


def codable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None, parts: int) -> DataFrame:
    """(id, label, vector array<double>) of the rows that have a code."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vec_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vector").isNotNull()).where(finite)
    n = F.size("vector")
    common_length = rows.where((n > 0) & (n % parts == 0)).groupBy(n.alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.lit(False)) if common_length is None else rows.where(n == common_length["n"])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _assigned(rows: DataFrame, books: Books, moved: list[np.ndarray] | None) -> DataFrame:
    """rows with codes, distances and error by these codebooks; written once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            named = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            x, n, parts = integers(_matrix(named["vector"])), batch.num_rows, len(books)
            width = x.shape[1] // parts
            codes, kept, error = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64), np.zeros(n, object)
            if moved is not None:
                old = np.frombuffer(b"".join(named["codes"].to_pylist()), np.uint8).reshape(n, parts)
                old_d = np.frombuffer(b"".join(named["distances"].to_pylist()), np.int64).reshape(n, parts)
            for p, book in enumerate(books):
                piece = x[:, p * width : (p + 1) * width]
                code, d = scan(piece, book) if moved is None else rescan(piece, book, moved[p], old[:, p].astype(np.int64), old_d[:, p])
                codes[:, p], error = code, error + d.astype(object)
                kept[:, p] = d if d.dtype != object else [v if v < 1 << 62 else -1 for v in d]
            made = [pa.array([r.tobytes() for r in codes], pa.binary()), pa.array([r.tobytes() for r in kept], pa.binary()), pa.array([min(int(e), _MOST) for e in error], pa.int64())]
            yield pa.RecordBatch.from_arrays([named["id"], named["label"], named["vector"], *made], names=["id", "label", "vector", "codes", "distances", "error"])

    schema = common.schema_of(rows.select("id", "label", "vector"), "codes binary, distances binary, error bigint")
    return common.cut(common.arrow(rows, run, schema))


def _limbs(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """values as sums of limb * 2**(_LIMB * k); small values have one limb."""
    k = 0
    while values.dtype == object and any(abs(v) >= 1 << (_LIMB - 1) for v in values.ravel()):
        yield k, (values & ((1 << _LIMB) - 1)).astype(np.int64)
        values, k = values >> _LIMB, k + 1
    yield k, values.astype(np.int64)


def _sums(coded: DataFrame, books: Books) -> dict[tuple[int, int, int], int]:
    """(part, entry, component) -> sum over its parts; component -1 is their count.  As many keys as codebooks have numbers."""
    shapes = [b.shape for b in books]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes = integers(_matrix(batch.column(0))), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            out: list[tuple[int, int, int, int, int]] = []
            for p, (entries, width) in enumerate(shapes):
                code = codes[:, p].astype(np.int64)
                counts = np.bincount(code, minlength=entries)
                for k, limb in _limbs(x[:, p * width : (p + 1) * width]):
                    total = np.zeros((entries, width), np.int64)
                    np.add.at(total, code, limb)
                    out += [(p, e, j, k, int(total[e, j])) for e in np.flatnonzero(counts).tolist() for j in range(width)]
                out += [(p, e, -1, 0, int(counts[e])) for e in np.flatnonzero(counts).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int32()] * 4, pa.int64()), strict=True)], names=["part", "entry", "component", "limb", "total"])

    rows = common.arrow(coded.select("vector", "codes"), run, "part int, entry int, component int, limb int, total bigint")
    found: dict[tuple[int, int, int], int] = {}
    for r in rows.groupBy("part", "entry", "component", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        key = (r["part"], r["entry"], r["component"])
        found[key] = found.get(key, 0) + (int(r["total"]) << (_LIMB * r["limb"]))
    return found


def _replaced(books: Books, sums: dict[tuple[int, int, int], int]) -> tuple[Books, list[np.ndarray]]:
    """Codebooks of floored means, and which entries differ from those before."""
    out, moved = [], []
    for p, book in enumerate(books):
        new = [[sums[p, e, j] // sums[p, e, -1] for j in range(book.shape[1])] if (p, e, -1) in sums else list(map(int, book[e])) for e in range(len(book))]
        moved.append(np.array([list(map(int, a)) != b for a, b in zip(book, new, strict=True)]))
        small = all(abs(v) < _SMALL for row in new for v in row)
        out.append(np.array(new, np.int64 if small else object))
    return out, moved


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Coded:
    """Codebooks after `rounds` rounds, and all vectors coded by them; at most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has one byte")
    rows = codable(vectors, id_col, vec_col, label_col, parts)
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not seeds:
        return Coded(rows.select("*", F.lit(b"").alias("codes"), F.lit(b"").alias("distances"), F.lit(0).cast("bigint").alias("error")), [])
    first = integers(np.array([r["vector"] for r in seeds]))
    width = first.shape[1] // parts
    books = [first[:, p * width : (p + 1) * width] for p in range(parts)]
    coded, moved = _assigned(rows, books, None), None
    for _ in range(rounds):
        books, moved = _replaced(books, _sums(coded, books))
        coded = _assigned(coded, books, moved)
    return Coded(coded, books)


def digest(books: Books) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and component."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()


def code_text(codes: Column) -> Column:
    """Two hexadecimal digits for each part."""
    return F.lower(F.hex(codes))


def with_label_error(coded: DataFrame, few: int = FEW_LABELS) -> DataFrame:
    """coded with label_error: the error summed over rows of its label, null being a label too."""
    named = coded.withColumn("_label", F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string"))))
    totals = named.groupBy("_label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    n = totals.count()
    joined = named.join(F.broadcast(totals), "_label") if n <= few else spread_join(named, totals, "_label", "id")
    return joined.drop("_label")


def reconstruct(codes: Column, books: Books) -> Column:
    """The vector that a code stands for: the middles of its entries' components."""
    def part(p: int) -> Callable[[Column], Column]:
        values = F.lit([[(int(v) + 0.5) / SCALE for v in entry] for entry in books[p]])
        return lambda c: F.get(values, F.conv(F.hex(F.substring(c, p + 1, 1)), 16, 10).cast("int"))

    return F.flatten(F.array(*(part(p)(codes) for p in range(len(books)))))


#: The same codes in DuckDB, every part scanning its whole codebook.
_DISTANCE = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"


def _assign_sql(book: str) -> str:
    return f"select vec_id, m, any_value(x) as x, min({_DISTANCE} * {ENTRIES} + e) as best from p join {book} using (m) group by vec_id, m"


def _replace_sql(book: str, assigned: str) -> str:
    return f"""select m, e, coalesce(n.c, o.c) as c from {book} o left join (select m, e, list(v order by i) as c from (select m, best % {ENTRIES} as e, i, cast(floor(sum(x[i]) / cast(count(*) as double)) as bigint) as v
        from (select *, unnest(range(1, len(x) + 1)) as i from {assigned}) group by all) group by all) n using (m, e)"""


ORACLE = f"""with k as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * x) as bigint)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, m, v[m * (len(v) // {PARTS}) + 1 : (m + 1) * (len(v) // {PARTS})] as x from (select *, unnest(range(0, {PARTS})) as m from k)),
c0 as materialized (select m, row_number() over (partition by m order by vec_id) - 1 as e, x as c from p qualify e < {ENTRIES}),
a1 as materialized ({_assign_sql('c0')}),
c1 as materialized ({_replace_sql('c0', 'a1')}),
a2 as materialized ({_assign_sql('c1')}),
c2 as materialized ({_replace_sql('c1', 'a2')}),
a3 as materialized ({_assign_sql('c2')}),
coded as materialized (select vec_id, string_agg(lower(lpad(to_hex(best % {ENTRIES}), 2, '0')), '' order by m) as code, cast(sum(best // {ENTRIES}) as bigint) as error from a3 group by vec_id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
    (select sha256(string_agg(cast(v as varchar), ',' order by m, e, i)) from (select m, e, unnest(c) as v, generate_subscripts(c, 1) as i from c2)) as codebooks_sha256 from coded join k using (vec_id)"""
