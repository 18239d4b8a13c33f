"""Packing by lexical retrieval.

Documents become token ids with an end id and are packed into sequences of at
most WINDOW tokens.  Document frequencies, the number of documents and their
mean length are counted once, over all documents.  One shuffle then brings
related documents together: every document gets KEYS min-hashes of its tokens,
weighted by idf (two documents share one with the probability of their
weighted resemblance), and the corpus is dealt out and sorted by them.  Tokens
of a single document weigh nothing, as they relate it to no other.

Every task cuts its rows, in that order, into shards of at most SHARD_DOCS
documents and about SHARD_TOKENS tokens, and indexes a shard by BM25 over
token ids (an inverted index with the corpus's weights).  A seed document
opens a sequence; the index ranks the shard's unused documents against all its
tokens, and they fill the sequence in that order.  The one that doesn't fit is
cut, and what is left of it is the next seed.  A document longer than a window
fills sequences of its own first.

The search of a seed ends at its shard: related documents whose first
min-hashes differ are not found.  README.md has the measured share.

What a shard leaves unfinished seeds the next one; what a partition leaves is
cut into sequences whose lengths are powers of two, the largest first, so
that none needs padding.

Ranges of the keys end in a hash of the row, so that a large group of copies
is dealt over as many partitions as its size asks for.  Texts are encoded
once; the ids are kept compressed in the checkpoint folder.  A sequence's
number holds its partition's.

Tokens are those of the tokenizers library (batch_bpe.py encodes).

Texts: null or empty ones have the end id only.  Texts are read whole.
Repeated rows are packed each, rows with a null id too.  An empty table
gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm import common
from logspark.llm.batch_bpe import LONG, encoder

WINDOW = 2048
END = 1
SHARD_DOCS = 1024
SHARD_TOKENS = 1_500_000
K1, B = 1.2, 0.75
#: Min-hashes by which documents are brought together.
KEYS = 4
#: Scores by tokens of at least this share of a shard's documents come from products of matrices, BLOCK tokens at a time.
COMMON, BLOCK = 1 / 16, 2048


@dataclass
class Corpus:
    """What BM25 needs of all documents: their number, mean length and each token's document frequency."""

    n: int
    mean: float
    df: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Corpus:
        df = _frequencies(docs)
        return cls(len(docs), sum(map(len, docs)) / len(docs), df)

    def idf(self) -> np.ndarray:
        return np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))

    def places(self) -> np.ndarray:
        """For each of KEYS orders the place of every token: idf-weighted random draws, tokens of one document last."""
        draws = np.random.default_rng(1).exponential(size=(KEYS, len(self.df)))
        weight = np.where(self.df > 1, self.idf(), 0.0)
        with np.errstate(divide="ignore"):
            draws = draws / weight
        return draws.argsort(1, kind="stable").argsort(1, kind="stable").astype(np.int32)


def _frequencies(docs: list[np.ndarray], size: int = 0) -> np.ndarray:
    """In how many documents each token is, for `size` tokens at least: of a token's places in a document one is kept."""
    place = np.zeros(max(size, 1 + max((int(ids.max()) for ids in docs if len(ids)), default=-1)), np.int64)
    kept = []
    for ids in docs:
        own = np.arange(len(ids))
        place[ids] = own
        kept.append(ids[place[ids] == own])
    return np.bincount(np.concatenate(kept), minlength=len(place))


def _postings(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, document, times) for each pair of them, by token, then document: one sort of all ids."""
    n, sizes = len(docs), list(map(len, docs))
    flat = np.concatenate(docs)
    small = not len(flat) or (int(flat.max()) + 1) * n < 1 << 32
    keys = flat.astype(np.uint32 if small else np.uint64) * n + np.repeat(np.arange(n, dtype=np.uint32), sizes)
    keys.sort()
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    term, owner = np.divmod(keys[at], n)
    return term.astype(np.int64), owner.astype(np.int64), np.diff(at, append=len(keys))


class Index:
    """BM25 weights of a shard's documents by token; df, idf and mean length are the corpus's (by default the shard is all)."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        corpus = corpus or Corpus.of(docs)
        self.n = n = len(docs)
        term, owner, tf = _postings(docs)
        length = np.fromiter(map(len, docs), float, n)
        norm = K1 * (1 - B + B * length / corpus.mean)
        weight = corpus.idf()[term] * tf * (K1 + 1) / (tf + norm[owner])
        size = np.bincount(term)
        often = size >= max(2, n * COMMON)
        #: Scores of each document (column) for each seed (row) by the common tokens.
        self.common = np.zeros((n, n))
        place = np.cumsum(often)[term] - 1
        shared, last = often[term], int(often.sum())
        for a in range(0, last, BLOCK):
            some = np.flatnonzero(shared & (place >= a) & (place < a + BLOCK))
            has, weighs = np.zeros((2, n, min(BLOCK, last - a)))
            has[owner[some], place[some] - a] = 1
            weighs[owner[some], place[some] - a] = weight[some]
            self.common += has @ weighs.T
        # The others have short lists of documents, and every document a list of them.
        self.owner, self.weight = owner[~shared], weight[~shared]
        size = np.where(often, 0, size)
        self.begin = np.concatenate(([0], np.cumsum(size)))
        self.terms = np.split(term[~shared][np.argsort(self.owner, kind="stable")], np.cumsum(np.bincount(self.owner, minlength=n))[:-1])

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms[seed]
        a = self.begin[terms]
        size = self.begin[terms + 1] - a
        at = np.repeat(a - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(size.sum())
        return self.common[seed] + np.bincount(self.owner[at], weights=self.weight[at], minlength=self.n)


class Packer:
    """Pieces (row, start, length, sequence, offset) of one partition, rows numbered as they came."""

    def __init__(self, window: int, corpus: Corpus | None = None):
        self.window, self.corpus = window, corpus
        self.sequence, self.filled = 0, 0
        self.open: list[tuple[int, int, int]] = []  # (row, start, length) of the sequence that is being filled

    def put(self, row: int, start: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
        while length:
            take = min(length, self.window - self.filled)
            self.open.append((row, start, take))
            self.filled += take
            start, length = start + take, length - take
            if self.filled == self.window:
                yield from self.close()

    def close(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Give out what is open, in sequences of a window or a power of two."""
        rest = self.filled
        pieces, self.open, self.filled = self.open, [], 0
        room = offset = 0
        for row, start, length in pieces:
            while length:
                if not room:
                    room, offset = (rest if rest == self.window else 1 << (rest.bit_length() - 1)), 0
                    rest -= room
                    self.sequence += 1
                take = min(length, room)
                yield row, start, take, self.sequence - 1, offset
                start, length, room, offset = start + take, length - take, room - take, offset + take

    def shard(self, first_row: int, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        index, free = Index(docs, self.corpus), np.ones(len(docs), bool)
        last: int | None = None  # the document that seeds what is open
        for seed in range(len(docs)):
            if not free[seed]:
                continue
            if last is None or not self.filled:
                free[seed] = False
                last = seed
                yield from self.put(first_row + seed, 0, len(docs[seed]))
            while last is not None and self.filled and free.any():
                chosen = last
                scores = np.where(free, index.scores(chosen), -1.0)
                for k in _best_first(scores, int(free.sum())):
                    free[k] = False
                    last = k
                    before = self.sequence
                    yield from self.put(first_row + k, 0, len(docs[k]))
                    if self.sequence != before:
                        break
        # What is open goes on with the next shard's first document.


def _best_first(scores: np.ndarray, n: int, some: int = 16) -> Iterator[int]:
    """Indices of the n largest scores, largest first, ties by index; few are sorted unless more are asked for."""
    if n > some:
        least = np.partition(scores, len(scores) - some)[len(scores) - some]
        few = np.flatnonzero(scores >= max(least, 0))
        few = few[np.argsort(-scores[few], kind="stable")]
        yield from few.tolist()
        given = set(few.tolist())
        yield from (int(k) for k in np.argsort(-scores, kind="stable")[:n] if int(k) not in given)
    else:
        yield from (int(k) for k in np.argsort(-scores, kind="stable")[:n])


def _narrow(ids: np.ndarray) -> np.ndarray:
    """Two bytes an id where that does: less to compress."""
    return ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids


def _packed(ids: np.ndarray) -> bytes:
    """The width of an id in bytes, then the ids compressed."""
    narrow = _narrow(ids)
    return bytes([narrow.itemsize]) + pa.compress(narrow.tobytes(), codec="zstd", asbytes=True)


def _ids(packed: bytes, n: int) -> np.ndarray:
    width = packed[0]
    plain = pa.decompress(memoryview(packed)[1:], decompressed_size=width * n, codec="zstd", asbytes=True)
    return np.frombuffer(plain, np.uint16 if width == 2 else np.uint32).astype(np.uint32)


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, n, packed): each row's number of tokens and its ids, compressed; encoded once and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).many
        for rows, texts in common.chunks(batches, limit=LONG):
            n, packed = [], []
            for ids in encode([text or b"" for text in texts]):
                ids = np.append(ids, np.uint32(end))
                n.append(len(ids))
                packed.append(_packed(ids))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n", "packed"])
        encoder(path).forget()

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return common.cut(common.arrow(rows, run, f"doc_id {kind_of_id}, n long, packed binary"))


def corpus_of(rows: DataFrame) -> Corpus:
    """Counted over all rows of encoded(); a number for each token of the vocabulary comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            some = [_ids(packed, n) for n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            found = _frequencies(some, len(df))
            found[: len(df)] += df
            df, docs, length = found, docs + len(some), length + sum(map(len, some))
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, [-1, -2])), pa.array(np.append(df[terms], [docs, length]))], names=["term", "n"])

    sums = common.arrow(rows.select("n", "packed"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in sums}
    n, length = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return Corpus(n, length / max(n, 1), df)


def together(rows: DataFrame, corpus: Corpus) -> DataFrame:
    """Rows of encoded(), dealt out and sorted by min-hashes, so that related documents follow each other."""
    places = corpus.places()
    keys = [f"key{k}" for k in range(KEYS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            docs = [_ids(packed, n) for n, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            begin = np.concatenate(([0], np.cumsum([len(d) for d in docs])[:-1]))
            flat = np.concatenate(docs)
            found = [pa.array(np.minimum.reduceat(place[flat], begin)) for place in places]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=["doc_id", "n", "packed", *keys])

    keyed = common.arrow(rows, run, common.schema_of(rows, ", ".join(f"{k} int" for k in keys)))
    order = [*keys, F.xxhash64("doc_id", "packed")]
    # Some shards to a partition, however small or large the corpus.
    parts = 1 + int(max(corpus.n // (2 * SHARD_DOCS), corpus.n * corpus.mean // (2 * SHARD_TOKENS)))
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n", "packed")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, corpus)
        ids: list = []  # of the rows whose pieces may still be given out
        tokens: list[np.ndarray] = []
        base = first = 0  # number of the first row held; of the open shard's first row
        partition = 0
        held = 0

        def give(pieces: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
            parts = [tokens[row - base][start : start + n] for row, start, n, _, _ in pieces]
            columns = [
                pa.array([ids[p[0] - base] for p in pieces], kind),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64()),
                pa.array([len(tokens[p[0] - base]) for p in pieces], pa.int64()),
                pa.array([partition << 33 | p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            if batch.num_rows:
                partition = batch.column(3)[0].as_py()
            for key, n, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids.append(key)
                tokens.append(_ids(packed, n))
                held += len(tokens[-1])
                if held >= SHARD_TOKENS or len(ids) - (first - base) >= SHARD_DOCS:
                    pieces = list(packer.shard(first, tokens[first - base :]))
                    if pieces:
                        yield give(pieces)
                    # Only rows with an open piece are needed from here on.
                    first, held = base + len(ids), 0
                    keep = min([row for row, _, _ in packer.open], default=first)
                    ids, tokens, base = ids[keep - base :], tokens[keep - base :], keep
        if kind is not None:
            pieces = list(packer.shard(first, tokens[first - base :])) if first < base + len(ids) else []
            pieces += list(packer.close())
            if pieces:
                yield give(pieces)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind_of_id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    found = encoded(docs, path, end)
    corpus = corpus_of(found)
    rows = together(found, corpus).select("doc_id", "n", "packed", F.spark_partition_id().alias("partition"))
    return common.arrow(rows, run, schema)
