r"""Benchmark decontamination: a positional inverted index of documents, asked for the phrases of test items.

Words are runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z are lower-cased.

`build` writes the index to the checkpoint folder: one row a shard, with its
documents, its terms, and each term's postings, which are the places of the
term among the shard's words, ascending, stored as gaps.  A shard holds whole
documents of about SHARD_BYTES, or a piece of a longer text with CONTEXT words
around it, so that whatever touches a word lies in the shard that owns it.

`search` asks every shard for every window of WINDOW item words (an item of
fewer words, but not none, is one window).  In a shard a window's terms are
taken from the rarest on: the rarest one's postings, less the term's offset,
are the candidate starts, and the offset-adjusted postings of the others, in
order of their number, are intersected with these.  A window with a term that
the shard lacks is done at once.  With a `slop` every term may lie up to that
many words from its place: proximity matches (those of slop 0 are the phrases).

Items go to the tasks in blocks of about BLOCK_WORDS words, the index is read
once for each block.  Candidates are handled MOST_CANDIDATES at a time, so very
common terms take time, not memory.

Null texts have no words.  Every row of documents has one row in the result,
whatever its id; null ids are kept.  Rows of one item id are one item, the id
null is an item named `null`; items without words match nothing.  Terms of one
shard are told apart by 64-bit hashes, terms of items are compared byte by byte.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.llm import common
from logspark.llm.wordscan import Words

WINDOW, SLOP = 10, 2
SHARD_BYTES = 1 << 20
#: Words of a long text's neighbouring pieces that a shard holds too: the longest window with its slop.
CONTEXT = 64
BLOCK_WORDS = 200_000
MOST_CANDIDATES = 1 << 20

SEPARATORS = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    SEPARATORS[_low : _high + 1] = True
_SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return _WORD.findall(raw.translate(_LOWER))


# --- the index -----------------------------------------------------------------


def _postings(words: Words) -> tuple[list[bytes], np.ndarray, bytes]:
    """(terms, their counts, packed postings): for each term its places ascending, as gaps from the one before."""
    h = words.hashes()
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(h) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(h)))
    gaps = np.diff(order, prepend=0)
    gaps[first] = order[first]
    raw, at = words.buf.tobytes(), order[first]
    terms = [raw[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]
    return terms, counts, zlib.compress(gaps.astype("<u4").tobytes(), 1)


def unpack(counts: np.ndarray, packed: bytes) -> np.ndarray:
    """Places of all terms, one term's after the other's."""
    gaps = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)
    if not len(gaps):
        return gaps
    run = np.cumsum(gaps)
    first = np.cumsum(counts) - counts
    return run - np.repeat(run[first] - gaps[first], counts)


def _pieces(text: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(piece with its context, first own word, words owned) of a long text, cut between words."""
    start, before = 0, 0  # own bytes begin; context begins
    while start < len(text):
        cut = _SEPARATOR.search(text, start + SHARD_BYTES)
        end = cut.start() if cut else len(text)
        after = end
        for k, m in enumerate(_WORD.finditer(text, end)):
            if k == CONTEXT:
                break
            after = m.end()
        piece = text[before:after]
        places = [m.start() + before for m in _WORD.finditer(piece)]
        own = [k for k, p in enumerate(places) if start <= p < end]
        yield piece, own[0] if own else 0, len(own)
        if own:
            before = places[max(0, own[-1] + 1 - CONTEXT)]
        start = end


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of docs, written once; a shard a row.

    rows: a number for each row of docs; ids; starts: where each document's words begin (and the last one's end);
    own_first, own_count: which of them belong to this shard (in words from its start); base: the document's words
    before the shard's first one.  terms, counts, postings: as told above.
    """
    id_type = docs.schema[id_col].dataType

    def shard(raw: list[bytes], rows: list[int], ids: pa.Array, own: tuple[int, int, int] | None) -> pa.RecordBatch:
        words = Words(raw, lower=True, separators=SEPARATORS)
        terms, counts, packed = _postings(words)
        sizes = words.counts.tolist()
        lists = [pa.array([x], t) for x, t in ((rows, pa.list_(pa.int64())), (words.first.tolist(), pa.list_(pa.int32())), ([own[0]] if own else [0] * len(raw), pa.list_(pa.int32())), ([own[1]] if own else sizes, pa.list_(pa.int32())), ([own[2]] if own else [0] * len(raw), pa.list_(pa.int64())), (terms, pa.list_(pa.binary())), (counts.tolist(), pa.list_(pa.int32())))]
        id_list = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([lists[0], id_list, *lists[1:], pa.array([packed], pa.binary())], names=["rows", "ids", "starts", "own_first", "own_count", "base", "terms", "counts", "postings"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch, raw in common.chunks(batches, "text", SHARD_BYTES):
            rows = list(range(number, number + len(raw)))
            number += len(raw)
            ids = batch.column(batch.schema.get_field_index("id"))
            if len(raw) > 1 or len(raw[0] or b"") <= 2 * SHARD_BYTES:
                yield shard([t or b"" for t in raw], rows, ids, None)
                continue
            done = 0
            for piece, first, n in _pieces(raw[0]):
                yield shard([piece], rows, ids, (first, n, done - first))
                done += n

    schema = T.StructType([T.StructField("rows", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(id_type)), *T._parse_datatype_string("starts array<int>, own_first array<int>, own_count array<int>, base array<bigint>, terms array<binary>, counts array<int>, postings binary").fields])
    return common.cut(common.arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, schema))


# --- the questions -----------------------------------------------------------------


@dataclass
class Phrases:
    """Different windows: terms' numbers, -1 behind a short one; items[w] are the item names of window w."""

    terms: list[bytes]
    windows: np.ndarray
    sizes: np.ndarray
    items: list[tuple[str, ...]]


def phrases(items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> Phrases:
    found: dict[tuple[bytes, ...], set[str]] = {}
    for name, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[k : k + window]), set()).add(name)
    terms = sorted({t for g in found for t in g})
    number = {t: k for k, t in enumerate(terms)}
    grams = list(found)
    windows = np.full((len(grams), window), -1, np.int64)
    for k, g in enumerate(grams):
        windows[k, : len(g)] = [number[t] for t in g]
    return Phrases(terms, windows, (windows >= 0).sum(1), [tuple(sorted(found[g])) for g in grams])


class Shard:
    """Postings of one row of the index, and matches in it."""

    def __init__(self, starts: np.ndarray, terms: pa.Array, counts: np.ndarray, packed: bytes):
        self.starts, self.terms, self.counts, self.packed = starts, terms, counts, packed
        self.n = int(starts[-1]) if len(starts) else 0
        self._keys: np.ndarray | None = None

    @property
    def keys(self) -> np.ndarray:
        """term * n + place, ascending."""
        if self._keys is None:
            self._keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.n + unpack(self.counts, self.packed)
        return self._keys

    def matches(self, asked: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every match."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(asked.windows) or not self.n:
            return none
        local = pc.index_in(pa.array(asked.terms, pa.binary()), value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.append(np.where(local >= 0, self.counts[local], 0), np.iinfo(np.int64).max)[asked.windows]  # -1: the last, never rarest
        alive = np.flatnonzero(number.min(1) > 0)
        if not len(alive):
            return none
        order = np.argsort(number[alive], axis=1, kind="stable")
        rarest = number[alive, order[:, 0]] * (2 * slop + 1)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        done, upto = 0, np.cumsum(rarest)
        while done < len(alive):
            end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + MOST_CANDIDATES, side="right")))
            found.append(self._intersect(asked, local, alive[done:end], order[done:end], slop))
            done = end
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _intersect(self, asked: Phrases, local: np.ndarray, windows: np.ndarray, order: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        term_first = np.cumsum(self.counts) - self.counts
        rare = local[asked.windows[windows, order[:, 0]]]
        n = self.counts[rare].astype(np.int64)
        row = np.repeat(np.arange(len(windows)), n)  # one candidate for each posting of the rarest term
        place = self.keys[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(term_first[rare], n)] - rare[row] * self.n
        start = place - order[row, 0]
        if slop:
            # The rarest term may be off its place, and so may each other one: twice the slop, then every start near by.
            row, start = self._hold(asked, local, windows, order, row, start, 2 * slop, np.zeros_like(start), np.full_like(start, self.n))
            row = np.repeat(row, 2 * slop + 1)
            start = (start[:, None] + np.arange(-slop, slop + 1)[None, :]).ravel()
        doc = np.searchsorted(self.starts, start, side="right") - 1
        known = (start >= 0) & (start < self.n)
        row, start, doc = row[known], start[known], doc[known]
        low, high = self.starts[doc], self.starts[doc + 1]
        inside = start + asked.sizes[windows[row]] <= high
        row, start = self._hold(asked, local, windows, order, row[inside], start[inside], slop, low[inside], high[inside])
        if slop:
            row, start = np.unique(np.stack([row, start]), axis=1)
        return windows[row], start

    def _hold(self, asked: Phrases, local: np.ndarray, windows: np.ndarray, order: np.ndarray, row: np.ndarray, start: np.ndarray, reach: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates of which every term has a posting within `reach` of its place and in [low, high); rarest terms first."""
        for k in range(asked.windows.shape[1]):
            at = order[row, k]
            numbers = asked.windows[windows[row], at]
            term, here = local[numbers], start + at
            a, b = np.maximum(here - reach, low), np.minimum(here + reach, high - 1)
            found = np.searchsorted(self.keys, term * self.n + a)
            hit = (a <= b) & (found < len(self.keys))
            hit[hit] = self.keys[found[hit]] <= (term * self.n + b)[hit]
            keep = hit | (numbers < 0)
            row, start, low, high = row[keep], start[keep], low[keep], high[keep]
        return row, start


def _asked(index: DataFrame, asked: Phrases, slop: int, count_words: bool) -> DataFrame:
    """(row, id, n_words, spans, items, near_items) of each document in each shard, of words that the shard owns."""

    def names(own: list[tuple[int, int]], starts: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> dict[int, list[str]]:
        out: dict[int, set[str]] = {}
        docs = np.searchsorted(starts, found[1], side="right") - 1
        for d, w, s in set(zip(docs.tolist(), found[0].tolist(), found[1].tolist(), strict=True)):
            first = int(starts[d]) + own[d][0]
            if s < first + own[d][1] and s + int(asked.sizes[w]) > first:
                out.setdefault(d, set()).update(asked.items[w])
        return {d: sorted(x) for d, x in out.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                rows, ids = named["rows"][k].as_py(), named["ids"][k].values
                starts, counts = (np.array(named[c][k].as_py(), np.int64) for c in ("starts", "counts"))
                own = list(zip(named["own_first"][k].as_py(), named["own_count"][k].as_py(), strict=True))
                base = named["base"][k].as_py()
                shard = Shard(starts, named["terms"][k].values, counts, named["postings"][k].as_py())
                exact = shard.matches(asked, 0)
                near = names(own, starts, shard.matches(asked, slop)) if slop else {}
                edge = np.zeros(shard.n + 1, np.int64)
                np.add.at(edge, exact[1], 1)
                np.add.at(edge, exact[1] + asked.sizes[exact[0]], -1)
                covered = np.cumsum(edge) > 0
                spans: list[list[dict]] = [[] for _ in rows]
                for d in np.unique(np.searchsorted(starts, exact[1], side="right") - 1).tolist():
                    first = int(starts[d]) + own[d][0]
                    part = np.concatenate(([False], covered[first : first + own[d][1]], [False]))
                    turn = np.flatnonzero(part[1:] != part[:-1]) + own[d][0] + base[d]
                    spans[d] = [{"from": a, "to": b} for a, b in turn.reshape(-1, 2).tolist()]
                hit = names(own, starts, exact)
                columns = [pa.array(rows, pa.int64()), ids, pa.array([n if count_words else 0 for _, n in own], pa.int64()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))]
                columns += [pa.array([x.get(d, []) for d in range(len(rows))], pa.list_(pa.string())) for x in (hit, near)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_words", "spans", "items", "near_items"])

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", index.schema["ids"].dataType.elementType), *T._parse_datatype_string("n_words bigint, spans array<struct<from: bigint, to: bigint>>, items array<string>, near_items array<string>").fields])
    return common.arrow(index, run, schema)


def _covered(spans: Column) -> Column:
    """Words in any of the spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(s: Column, x: Column) -> Column:
        more = F.greatest(F.lit(0).cast("bigint"), x["to"] - F.greatest(x["from"], s["end"]))
        return F.struct(F.greatest(s["end"], x["to"]).alias("end"), (s["n"] + more).alias("n"))

    return F.aggregate(F.array_sort(spans), start, step)["n"]


def search(index: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each of the indexed rows: id_col, n_words, n_hit, n_items, spans, items, near_items.

    spans (from, to): words that lie in an occurrence of a window, in places of the document; n_hit is their number.
    items: names of the items with occurring windows, as strings in order; near_items: of those with a window whose
    terms all lie within `slop` words of their places (empty if slop is 0).
    """
    if window + slop > CONTEXT:
        raise ValueError(f"window and slop are at most {CONTEXT} words together")
    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("name"), F.col(text_col).cast("string").alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))  # a word and its separator have about six bytes
    answers: DataFrame | None = None
    for k in range(blocks):
        block = named.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k)
        asked = phrases([(r["name"], r["text"]) for r in block.collect()], window)
        part = _asked(index, asked, slop, k == 0)
        answers = part if answers is None else answers.unionByName(part)
    together = answers.groupBy("row").agg(F.first("id").alias("id"), F.sum("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near_items")))
    sets = {c: F.array_sort(F.array_distinct(c)) for c in ("items", "near_items")}
    found = together.select("id", "n_words", _covered(F.col("spans")).alias("n_hit"), F.array_sort("spans").alias("spans"), *(x.alias(c) for c, x in sets.items()))
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "spans", "items", "near_items")


#: The same digest in DuckDB, over all runs of words.
ORACLE = rf"""with dw as materialized (select row_number() over () as rn, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
iw as (select coalesce(cast(item_id as varchar), 'null') as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
iws as materialized (select distinct item, w[i : i + {WINDOW} - 1] as g from (select item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as i from iw where len(w) > 0)),
gs as materialized (select row_number() over () as gid, g, len(g) as n from (select distinct g from iws)),
places as (select rn, i, w[i : i + n - 1] as g from (select rn, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, (select distinct n from gs))),
found as materialized (select rn, i, gid, n from places join gs using (g)),
hits as (select rn, count(distinct p) as n_hit from (select rn, unnest(range(i, i + n)) as p from found) group by rn),
names as (select rn, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct rn, item from found join gs using (gid) join iws on iws.g = gs.g) group by rn),
tokens as materialized (select rn, unnest(w) as t, generate_subscripts(w, 1) as p from dw),
df as (select t, count(*) as c from tokens group by t),
rare as (select gid, arg_min(k, c) as k, arg_min(t, c) as t from (select gid, unnest(g) as t, generate_subscripts(g, 1) as k from gs) join df using (t) group by gid),
shifted as (select distinct gid, rn, p - k + 1 + d as s from rare join tokens using (t), (select unnest(range(-{SLOP}, {SLOP} + 1)) as d)),
near as (select distinct rn, gid from shifted join gs using (gid) join dw using (rn) where s >= 1 and s + n - 1 <= len(w) and len(list_filter(range(1, n + 1), lambda k: not list_contains(w[greatest(s + k - 1 - {SLOP}, 1) : s + k - 1 + {SLOP}], g[k]))) = 0),
near_names as (select rn, count(distinct item) as n_near_items from near join gs using (gid) join iws on iws.g = gs.g group by rn)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near_items, 0) as n_near_items
from dw left join hits using (rn) left join names using (rn) left join near_names using (rn)"""
