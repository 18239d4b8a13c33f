"""Quality classifier: a factorisation machine.

Features of a text, each between 0 and 1:

* hashed words: lower-cased (A-Z) words, hashed to WORD_DIMS places, with
  the square root of their share of the text's words;
* structure: shares of upper-case letters, symbols, marks, digits, bytes
  outside ASCII and line ends, word length, distinct words, words equal to
  the word before;
* metadata: the text's size in words and bytes, as logarithms.

Score: sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j).  The pairs
are summed in time linear in the features by
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Fitting takes at most MAX_ROWS labelled rows: those whose hashed id is
smallest.  Their features are made by Spark tasks, the rest of the fit is
numpy on the driver.  Everything else covers all rows.

Texts: null or without words has no word features and is scored by its
structure.  Texts are read whole.  Repeated rows get equal scores.  Rows
with a null id are scored.  Without usable labels, or with one class only,
every score is that class's share (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm import common
from logspark.llm.wordscan import Words

#: Labelled rows used by a fit at most.
MAX_ROWS = 8000
WORD_DIMS = 1024
FACTORS = 4
#: From this score on a document is kept.
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _OTHER_MARK, _HIGH, _LINE, _SPACE = range(9)
_CLASS = np.full(256, _OTHER_MARK, np.int64)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = _UPPER, _LOWER, _DIGIT, _HIGH
_CLASS[list(b"#*$%&|<>@^~=_\\{}[]")], _CLASS[list(b"!?")], _CLASS[0x0A] = _SYMBOL, _BANG, _LINE
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _SPACE
STRUCTURE = ("upper", "symbols", "bangs", "marks", "digits", "high", "lines", "word_length", "distinct", "doubled", "log_words", "log_bytes", "few_words", "lone_symbols")


def structure(words: Words) -> np.ndarray:
    """A row for each text, columns as STRUCTURE."""
    n = len(words.first) - 1
    sizes = np.diff(words.text_start)
    of = np.repeat(np.arange(n), sizes)
    count = np.bincount(of * 9 + _CLASS[words.buf], minlength=9 * n).reshape(n, 9).astype(float)
    count[:, _LINE] -= 1  # the one that ends each text
    n_words = words.counts.astype(float)
    per_word = lambda x: np.minimum(1, x / np.maximum(n_words, 1))
    letters = np.maximum(1, count[:, _UPPER] + count[:, _LOWER] + count[:, _HIGH])
    h = words.hashes()
    doubled = np.zeros(n)
    if len(h):
        same = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
        doubled = np.bincount(words.doc[1:][same], minlength=n).astype(float)
    order = np.lexsort((h, words.doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
    distinct = np.bincount(words.doc[order][fresh], minlength=n)
    lone = np.bincount(words.doc, weights=(words.ends - words.starts == 1) & (_CLASS[words.buf[words.starts]] == _SYMBOL), minlength=n) if len(h) else np.zeros(n)
    solid = np.maximum(1, sizes - 1 - count[:, _SPACE] - count[:, _LINE])
    return np.column_stack(
        [
            count[:, _UPPER] / letters,
            np.minimum(1, 4 * count[:, _SYMBOL] / solid),
            per_word(count[:, _BANG]),
            per_word(count[:, _OTHER_MARK]),
            np.minimum(1, 4 * count[:, _DIGIT] / solid),
            count[:, _HIGH] / solid,
            per_word(count[:, _LINE]),
            np.minimum(1, solid / np.maximum(n_words, 1) / 20),
            # The share of distinct words falls with the length even in good prose: taken against Heaps' square root.
            np.minimum(1, distinct / np.maximum(1, np.sqrt(n_words) * 12)) * (n_words >= 50) + per_word(distinct) * (n_words < 50),
            per_word(doubled),
            np.minimum(1, np.log1p(n_words) / 12),
            np.minimum(1, np.log1p(sizes - 1) / 16),
            np.exp(-n_words / 25),
            per_word(lone),
        ]
    )


def hashed_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value), sorted by text and place."""
    n = len(words.first) - 1
    place = (words.hashes() >> np.uint64(20)).astype(np.int64) % WORD_DIMS
    key, count = np.unique(words.doc * WORD_DIMS + place, return_counts=True)
    of = key // WORD_DIMS
    return of, key % WORD_DIMS, np.sqrt(count / np.maximum(1, words.counts)[of]) if n else count


@dataclass
class Machine:
    """b, w and v of the score; w and v have WORD_DIMS rows for words, then one for each structure column."""

    b: float
    w: np.ndarray
    v: np.ndarray

    def logit(self, texts: list[bytes | None]) -> np.ndarray:
        words = Words(texts, lower=False)
        dense = structure(words)
        of, place, x = hashed_words(Words(texts, lower=True))
        n = len(texts)
        w, v = self.w[WORD_DIMS:], self.v[WORD_DIMS:]
        linear = dense @ w + np.bincount(of, weights=self.w[place] * x, minlength=n)
        sums, squares = dense @ v, (dense**2) @ (v**2)
        for f in range(v.shape[1]):
            part = self.v[place, f] * x
            sums[:, f] += np.bincount(of, weights=part, minlength=n)
            squares[:, f] += np.bincount(of, weights=part * part, minlength=n)
        return self.b + linear + 0.5 * (sums**2 - squares).sum(1)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(texts), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 40, seed: int = 1) -> Machine:
    """Adam on the logistic loss, minibatches of 128; L2 holds the words' weights."""
    rng = np.random.default_rng(seed)
    share = float(y.mean()) if len(y) else 0.5
    d = WORD_DIMS + len(STRUCTURE)
    if not len(y) or share in (0.0, 1.0):
        edge = min(max(share, 1e-6), 1 - 1e-6)
        return Machine(float(np.log(edge / (1 - edge))), np.zeros(d), np.zeros((d, FACTORS)))
    w, v, b = np.zeros(d), rng.normal(0, 0.05, (d, FACTORS)), float(np.log(share / (1 - share)))
    decay = np.where(np.arange(d) < WORD_DIMS, 2e-3, 1e-5)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v, np.zeros(1))]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), 128):
            rows = order[k : k + 128]
            xb = x[rows].astype(float)
            s = xb @ v
            z = b + xb @ w + 0.5 * (s**2 - (xb**2) @ (v**2)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            gw = xb.T @ g + decay * w
            gv = xb.T @ (g[:, None] * s) - ((xb**2).T @ g)[:, None] * v + decay[:, None] * v
            t += 1
            step = []
            for (m, q), grad in zip(state, (gw, gv, np.array([g.sum()])), strict=True):
                m += 0.1 * (grad - m)
                q += 0.01 * (grad**2 - q)
                step.append(0.03 * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.99**t)) + 1e-8))
            w, v, b = w - step[0], v - step[1], b - float(step[2][0])
    return Machine(b, w, v)


def labelled(docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """(text, label, key) of at most `rows` labelled documents outside the held-out fold, by smallest hashed id.

    Only labels of ids that docs has count; an id that several rows have gives its least text.  The rows are dealt
    over as many partitions as the session has cores; `key`, of the id, orders them.
    """
    usable = labels.select(F.col("doc_id").alias("_id"), F.col(column).cast("int").alias("label")).where(F.col("_id").isNotNull() & F.col("label").isin(0, 1))
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    there = usable.where(common.fold_bucket("_id", folds) != held_out).join(texts.select("_id"), "_id", "left_semi")
    one = there.groupBy("_id").agg(F.max("label").alias("label"))
    chosen = one.orderBy(F.xxhash64("_id"), "_id").limit(rows)  # at most `rows` pairs of numbers: safe to broadcast
    found = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return found.select("text", "label", F.xxhash64("_id").alias("key")).repartition(docs.sparkSession.sparkContext.defaultParallelism, "key")


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = 5, held_out: int = 0, rows: int = MAX_ROWS) -> Machine:
    """Learn from labelled rows whose crc32(doc_id) mod folds is not held_out."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.chunks(batches):
            dense = structure(Words(texts)).astype(np.float32)
            of, place, x = hashed_words(Words(texts, lower=True))
            cut = np.searchsorted(of, np.arange(len(texts) + 1))
            packed = [(place[a:b].astype(np.uint16).tobytes(), x[a:b].astype(np.float32).tobytes(), row.tobytes()) for a, b, row in zip(cut[:-1], cut[1:], dense, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in packed], pa.binary()) for k in range(3)] + [batch.column(1), batch.column(2)], names=["place", "x", "dense", "label", "key"])

    found = common.arrow(labelled(docs, labels, column, folds, held_out, rows), features, "place binary, x binary, dense binary, label int, key long")
    sample = found.toPandas().sort_values("key", kind="stable")
    x = np.zeros((len(sample), WORD_DIMS + len(STRUCTURE)), np.float32)
    for k, (place, value, dense) in enumerate(zip(sample["place"], sample["x"], sample["dense"], strict=True)):
        x[k, np.frombuffer(place, np.uint16)] = np.frombuffer(value, np.float32)
        x[k, WORD_DIMS:] = np.frombuffer(dense, np.float32)
    return train(x, sample["label"].to_numpy(dtype=float))


def score(docs: DataFrame, machine: Machine, keep: list[str] | None = None, threshold: float = THRESHOLD, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns `keep` (by default all) with a score double and a prediction int named `out`; of equal names, the new columns stay."""
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in [o.lower() for o in out]]
    text = common.unused(docs, "scored_text")
    rows = docs.select(*names, F.col("text").cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.chunks(batches, text):
            s = machine.score(texts)
            columns = [batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, *out])

    return common.arrow(rows, run, common.schema_of(rows.select(*names), f"`{out[0]}` double, `{out[1]}` int"))
