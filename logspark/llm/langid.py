"""Language identification by rank-order profiles.

A text's n-grams are the runs of one to three characters in its lower-cased
letters, with each run of other characters as one blank; a blank may begin
or end an n-gram.  Its profile is its TOP most frequent n-grams in order
(ties by the n-gram's code).  A language's profile is made the same way from
its texts together.  The out-of-place distance adds, over a text's n-grams,
how far each lies from its rank in the language's profile, TOP if it is
missing there.  The nearest language is predicted (ties: the first by name).

Profiles are learned from SAMPLE_PER_LANGUAGE rows of each language (all, where
it has fewer), chosen by a hash of the id and the row's own number; n-grams are counted by Spark, and only TOP n-grams of
each language come to the driver: 6 bytes each in the tasks, so 100,000
languages would be 240 MB.  There is no limit to their number.

Texts: null and texts without letters give `und` with score 0.  Texts are
read whole, long ones in pieces.  Repeated rows get equal predictions, rows with a null id are
predicted; rows with a null language teach nothing.  Without any labelled
row every text gives `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm import common

TOP = 400
SAMPLE_PER_LANGUAGE = 4000
#: Languages up to which their counts (some 30 bytes each) are broadcast.
FEW_LANGUAGES = 100_000
UNKNOWN = "und"
#: Characters of a text that are counted together.
PIECE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    return np.fromiter((k if chr(k).isalpha() else 0 for k in range(0x110000)), np.int64, 0x110000)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all different n-grams of one text (up to three code points, 21 bits each), ascending; how often each occurs.

    Long texts are counted in pieces; a piece begins with the last characters of the one before.
    """
    low, letters = text.lower(), _letters()
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after_letter = np.zeros(0, np.int64), True  # the text begins with a blank
    pieces = [low[k : k + PIECE] for k in range(0, len(low), PIECE)] or [""]
    pieces[0] = "\n" + pieces[0]
    pieces[-1] += "\n"
    for piece in pieces:
        own = letters[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = own > 0
        follows = np.concatenate(([after_letter], keep[:-1]))
        after_letter = bool(keep[-1])
        c = np.concatenate([before, own[keep | follows]])
        old = len(before)
        before = c[-2:].copy()
        one = c[old:]
        first, second = c[max(0, old - 1) : -1], c[max(0, old - 1) + 1 :]
        two = first | second << 21
        k = max(0, old - 2)
        three = (c[k:-2] | c[k + 1 : -1] << 21 | c[k + 2 :] << 42)[c[k + 1 : -1] > 0] if len(c) - k > 2 else c[:0]
        found, n = np.unique(np.concatenate([one[one > 0], two[two > 0], three]), return_counts=True)
        if not len(grams):
            grams, counts = found, n
        else:
            grams, at = np.unique(np.concatenate([grams, found]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, n])).astype(np.int64)
    return grams, counts


def profile(text: str) -> np.ndarray:
    grams, counts = ngrams(text)
    if len(grams) > TOP:
        # All that may be among the first TOP, then in order: by count, then by code.
        least = np.partition(counts, len(counts) - TOP)[len(counts) - TOP]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:TOP]


@dataclass
class Profiles:
    """languages; known n-grams in ascending order; for n-gram k the languages and ranks from begin[k] to begin[k + 1]."""

    languages: list[str]
    grams: np.ndarray
    begin: np.ndarray
    language: np.ndarray
    rank: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(text) if text else np.zeros(0, np.int64)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        place = np.flatnonzero(self.grams[at] == own)
        at = at[place]
        size = self.begin[at + 1] - self.begin[at]
        k = np.repeat(self.begin[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        near = TOP - np.abs(self.rank[k] - np.repeat(place, size))  # what an n-gram that is there saves of TOP
        distance = TOP * len(own) - np.bincount(self.language[k], weights=near, minlength=len(self.languages))
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (TOP * len(own)))


def _sample(rows: DataFrame, per_language: int, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text) of exactly per_language rows of each language, or of all where it has fewer; texts aren't shuffled.

    Each row has a hash of its id and its own number as read, so repeated and null ids are rows like any others.  A
    threshold by a language's count leaves about twice as many as asked for; of these hashes, without texts, the last
    one that belongs is found.
    """
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("h"))
    few = common.cut(rows.groupBy("lang").agg(F.count("*").alias("n")))
    small = few.count() <= FEW_LANGUAGES
    least, span = -(2.0**63), 2.0**64
    share = F.least(F.lit(1.0), (2 * per_language + 50) / F.col("n"))
    likely = rows.select("lang", "h").join(F.broadcast(few) if small else few, "lang").where((F.col("h").cast("double") - least) / span <= share)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = common.cut(likely.withColumn("place", place).where(F.col("place") <= per_language).groupBy("lang").agg(F.max("h").alias("last")))
    return rows.join(F.broadcast(last) if small else last, "lang").where(F.col("h") <= F.col("last")).select("lang", "text")


def learn(docs: DataFrame, usable: Column, per_language: int = SAMPLE_PER_LANGUAGE, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the languages in the rows where `usable` holds."""
    sample = _sample(docs.where(usable & F.col(lang_col).isNotNull()), per_language, text_col, lang_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text or "")
            for lang, texts in by.items():
                for k in range(0, len(texts), 200):
                    grams, n = ngrams("\n".join(texts[k : k + 200]))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    summed = common.arrow(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found = summed.withColumn("place", place - 1).where(F.col("place") < TOP).toPandas()
    languages, of = np.unique(found["lang"].to_numpy(dtype=str), return_inverse=True)
    gram, rank = found["gram"].to_numpy(np.int64), found["place"].to_numpy(np.int64)
    order = np.lexsort((of, gram))
    grams, sizes = np.unique(gram, return_counts=True)
    return Profiles(languages.tolist(), grams, np.concatenate(([0], np.cumsum(sizes))), of[order].astype(np.int32), rank[order].astype(np.int16))


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.arrow(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, f"{id_col} {kind}, lang_pred string, score double")
