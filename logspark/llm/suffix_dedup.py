"""Suffix-array dedup: repeated byte strings, by bucket-pointer refinement.

Removed is each byte covered by a string of LENGTH bytes that also starts
earlier: in a document with a smaller id, or earlier in the same document.
Documents are whole UTF-8 texts; strings never cross documents.

A suffix array is sorted here only as far as the answer needs: to LENGTH
bytes, and only where buckets hold more than one suffix.

* Dealing (`first_pass`): a window (a suffix of LENGTH bytes) is filed under
  the least hash among its Q-grams, which depends on its bytes alone, so
  equal windows meet.  Successive windows with the same one are a run, sent
  once with a hash of the bytes that it spans.  Long texts are looked at in
  segments that overlap by LENGTH - 1 bytes.
* First look (`settle`): runs filed together that span equal bytes have equal
  windows, so all but the earliest are repeated, whole.  A bucket with one
  span is settled; others stay open, and so does a run in which its own least
  Q-gram occurs twice, as its windows may repeat inside it.
* Sorting (`open_runs`, `refine`): the bytes of open runs are sent to the task
  that has their bucket, and their suffixes are sorted by `bucket_pointers`:
  buckets of the first bytes are numbered by their last place in the sorted
  order; each round sorts the members of a bucket by the numbers of the
  buckets in which the suffixes `depth` bytes later lie and numbers the parts
  anew within their parent's places.  Numbers that a round has made are read
  by the next, so the depth doubles; suffixes alone in their bucket are final
  and are not sorted again.  All numbers come from bytes.
* Windows that are still in one bucket at LENGTH bytes are equal: all but the
  earliest are repeated.

Shuffled are packed and compressed runs (one in about 30 bytes of text), the
texts, once, by document (both joins read the same shuffle), and the bytes of
open runs; the same plan at every size.  The hash of a span has 64 bits and
is compared only inside a bucket, with a span of the same length.

Hot buckets (`hot_buckets`): filing hashes with more than HOT_RUNS different
spans, found on a sixteenth of all pieces of text, whatever the size of the
table.  They are marked in a filter of HOT_BITS bits, 2 MB; a bucket that falls
on another's bit is dealt as a hot one, with the same results.  The windows of
hot buckets are dealt one by one, by two 64-bit hashes of their LENGTH bytes
together, after equal ones of one buffer are merged; so neither a passage in
very many documents nor its surroundings meet in one task.  The sample
decides how windows are dealt, never what is compared.

Parts (`parts_of`): a task holds one part of the buckets at a time; there are
as many as the texts' counted bytes ask for.

Ids are integers (others raise TypeError).  Null texts are empty.  Rows with
a null id come after all others.  Rows with equal id and text are one
document, each gets its result; equal ids with different texts are ordered by
the text's CRC, which is looked at only if ids repeat.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.llm import common
from logspark.llm.wordscan import _VALUE, mix, powers

LENGTH = 100
Q = 32
#: Bytes of the first buckets, sorted as one number.
FIRST = 8
#: Windows of one text looked at together, windows of one run at most, bytes of text whose runs are packed together.
SEGMENT, RUN_MOST, BUFFER = 900_000, 1024, 12 << 20
#: Bytes of runs sorted together; a bucket is never cut.
SORTED = 2 << 20
#: A bucket of more different spans is dealt by window; one piece of text in SAMPLED is looked at to find them.
HOT_RUNS, SAMPLED, PIECE = 5000, 16, 4096
#: Bits of the filter of hot buckets, and bytes of text whose buckets make a part at most, on average.
HOT_BITS, PART_BYTES = 1 << 24, 128 << 20
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_OTHER = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST_ID = np.iinfo(np.int64).max
RUN = np.dtype([("v", "<u4"), ("span", "<u8"), ("doc", "<i8"), ("crc", "<u4"), ("at", "<u4"), ("n", "<u2"), ("twice", "<u1")])
OPEN = np.dtype([("v", "<u4"), ("doc", "<i8"), ("crc", "<u4"), ("at", "<u4"), ("n", "<u2")])
WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("crc", "<u4"), ("at", "<u4")])
RANGE = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("at", "<u4"), ("n", "<u4")])
#: Kinds of packets.
KNOWN, RUNS, WINDOWS = 0, 1, 2


class Texts:
    """Texts of one batch in one buffer; all arrays are by byte of the buffer."""

    def __init__(self, raw: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.start = np.concatenate(([0], np.cumsum(self.sizes + 1)))
        self.sum = self._sums(_VALUE)
        self._second: np.ndarray | None = None

    def _sums(self, value: np.ndarray) -> np.ndarray:
        up, self.down = powers(len(self.buf) + 1)
        out = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(value[self.buf] * up[: len(self.buf)], out=out[1:])
        return out

    def grams(self, q: int) -> np.ndarray:
        """Hashes of the q-grams at all positions that have one."""
        n = len(self.buf) - q + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sum[q : q + n] - self.sum[:n]) * self.down[:n])

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[begin]) * self.down[begin] + (end - begin).astype(np.uint64) * _FACTOR)

    def second(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Other hashes of the same spans."""
        if self._second is None:
            self._second = self._sums(_OTHER)
        return mix((self._second[end] - self._second[begin]) * self.down[begin])

    def runs(self, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first window, windows, least hash, whether that may occur twice) of every run of windows."""
        b, many = self.grams(q), length - q + 1
        counts = np.maximum(0, self.sizes - length + 1)
        if not counts.sum():
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
        least, width = b, 1
        while 2 * width <= many:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < many:
            rest = many - width
            least = np.minimum(least[:-rest], least[rest:])
        edges = np.zeros(len(self.buf) + 1, np.int8)
        edges[self.start[:-1][counts > 0]] += 1
        edges[(self.start[:-1] + counts)[counts > 0]] -= 1
        valid = np.cumsum(edges, dtype=np.int8)[: len(least)].astype(bool)
        begins, ends = valid.copy(), valid.copy()
        begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        ends[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        v, n = least[first], last - first + 1
        twice = n > many
        offsets = np.arange(many)
        for k in range(0, len(first), 20_000):  # bounded blocks of runs x positions
            f, w = first[k : k + 20_000], v[k : k + 20_000, None]
            head = b[f[:, None] + offsets] == w
            tail = b[last[k : k + 20_000][:, None] + offsets] == w
            twice[k : k + 20_000] |= (head.sum(1) > 1) | (tail.sum(1) > 1) | (f + head.argmax(1) != last[k : k + 20_000] + tail.argmax(1))
        if (n > RUN_MOST).any():
            parts = -(-n // RUN_MOST)
            of = np.repeat(np.arange(len(n)), parts)
            skip = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN_MOST
            first, n, v, twice = first[of] + skip, np.minimum(n[of] - skip, RUN_MOST), v[of], twice[of]
        text = np.searchsorted(self.start, first, "right") - 1
        return text, first, n, v, twice


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.fill_null(_LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of size[0] places, then those of the next."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _planes(rows: np.ndarray, more: bytes = b"") -> bytes:
    """Byte after byte of all rows, field after field: bytes that hardly change lie together and are compressed away."""
    planes = b"".join(np.ascontiguousarray(rows[name]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for name in rows.dtype.names)
    return len(rows).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(planes + more)


def _rows(raw: bytes, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The rows of one packet, and the bytes after them."""
    n, at = int.from_bytes(raw[:4], "little"), 0
    planes = zstandard.ZstdDecompressor().decompress(raw[4:])
    out = np.empty(n, kind)
    for name in kind.names:
        size = kind[name].itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(planes[at : at + size * n], np.uint8).reshape(size, n).T).view(kind[name]).reshape(n)
        at += size * n
    return out, np.frombuffer(planes, np.uint8, offset=at)


def _later(*keys: np.ndarray) -> np.ndarray:
    """In sorted keys: whether a row's keys equal those of the row before."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    same = np.ones(len(keys[0]) - 1, bool)
    for key in keys:
        same &= key[1:] == key[:-1]
    return np.concatenate(([False], same))


def _windows_to_ranges(rows: np.ndarray) -> np.ndarray:
    """Windows (doc, crc, at) as ranges of successive ones."""
    rows = rows[np.lexsort((rows["at"], rows["crc"], rows["doc"]))]
    again = _later(rows["doc"], rows["crc"]) & np.concatenate(([False], rows["at"][1:].astype(np.int64) <= rows["at"][:-1].astype(np.int64) + 1)) if len(rows) else np.zeros(0, bool)
    begin = np.flatnonzero(~again)
    out = np.empty(len(begin), RANGE)
    out["doc"], out["crc"], out["at"] = rows["doc"][begin], rows["crc"][begin], rows["at"][begin]
    if len(begin):
        last = np.append(begin[1:], len(rows)) - 1
        out["n"] = rows["at"][last].astype(np.int64) - rows["at"][begin] + 1
    return out


def _firsts(rows: np.ndarray, *keys: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows in order of keys and occurrence, which are the first of their key, which occur after that first).

    Rows of one document at one place come from repeated rows of the table: such a one is neither.
    """
    rows = rows[np.lexsort((rows["at"], rows["crc"], rows["doc"], *(rows[k] for k in reversed(keys))))]
    fresh = ~_later(*(rows[k] for k in keys))
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))
    itself = (rows["doc"] == rows["doc"][head]) & (rows["crc"] == rows["crc"][head]) & (rows["at"] == rows["at"][head])
    return rows, fresh, ~itself


def _as_ranges(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), RANGE)
    for name in RANGE.names:
        out[name] = rows[name]
    return out


def bucket_pointers(text: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, numbers) of the suffixes that share their first `length` bytes with another, sorted by number.

    left[p]: bytes from p to the end of the span in which p lies.  Suffixes with fewer than `length` bytes left only
    lend their buckets.  A bucket's number is its last place in the order sorted so far.
    """
    first = min(FIRST, length)
    at = np.flatnonzero(left >= first)
    padded = np.concatenate([text, np.zeros(FIRST, np.uint8)])
    key = np.zeros(len(text), np.uint64)
    for k in range(first):
        key = key << np.uint64(8) | padded[k : k + len(text)]
    order = np.argsort(key[at])
    at, key = at[order], key[at[order]]
    number = np.zeros(len(text), np.int64)

    def last_places(new: np.ndarray) -> np.ndarray:
        """For each row of a sorted order, the last place of its bucket; new marks where buckets begin."""
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(new)) - 1
        return np.repeat(end, end - begin + 1)

    number[at] = last_places(~_later(key))
    depth = first
    while True:
        step = min(depth, length - depth)
        at = at[left[at] >= depth + step]
        same = _later(number[at])
        shared = same | np.append(same[1:], False) if len(at) else same
        at = at[shared]
        if not step or not len(at):
            return at, number[at]
        parent, later = number[at], number[at + step]
        order = np.argsort(parent << 32 | later, kind="stable")
        at, parent, later = at[order], parent[order], later[order]
        parent_end = last_places(~_later(parent))
        number[at] = parent - (parent_end - last_places(~_later(parent, later)))
        depth += step


def repeated_windows(rows: np.ndarray, spans: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """Ranges of windows that equal an earlier one; spans[begin:] holds the bytes of each run.  Whole buckets only."""
    order = np.lexsort((rows["v"], rows["at"], rows["crc"], rows["doc"]))  # places in order of occurrence
    order = order[~_later(*(rows[k][order] for k in ("doc", "crc", "at", "v")))]
    rows, begin = rows[order], begin[order]
    size = rows["n"].astype(np.int64) - 1 + length
    text = spans[_places(begin, size)]
    left = np.repeat(np.cumsum(size), size) - np.arange(len(text))
    at, number = bucket_pointers(text, left, length)
    order = np.lexsort((at, number))
    at, number = at[order], number[order]
    at = at[_later(number)]
    start = np.cumsum(size) - size
    of = np.searchsorted(start, at, "right") - 1
    gone = np.empty(len(at), WINDOW)
    own = rows[of]
    gone["doc"], gone["crc"], gone["at"] = own["doc"], own["crc"], own["at"] + (at - start[of])
    return _windows_to_ranges(gone)


def _segments(batches: Iterator[pa.RecordBatch], length: int, with_crc: bool) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, doc, crc, first byte) of segments of texts, some at a time; equal texts are cut equally."""
    held: list[tuple[bytes, int, int, int]] = []
    size = 0

    def given():
        raw, doc, crc, at = zip(*held, strict=True)
        return list(raw), np.array(doc, np.int64), np.array(crc, np.uint32), np.array(at, np.int64)

    for batch, texts in common.chunks(batches):
        for key, text in zip(_ids(batch.column(0)).tolist(), texts, strict=True):
            if text is None or len(text) < length:
                continue
            crc = zlib.crc32(text) if with_crc else 0
            for s in range(0, len(text) - length + 1, SEGMENT):
                piece = text[s : s + SEGMENT + length - 1]
                if size and size + len(piece) > common.CHUNK_BYTES:
                    yield given()
                    held, size = [], 0
                held.append((piece, key, crc, s))
                size += len(piece)
    if held:
        yield given()


def hot_buckets(docs: DataFrame, length: int, q: int, most: int = HOT_RUNS, sampled: int = SAMPLED, n_bits: int = HOT_BITS) -> np.ndarray:
    """The filter of buckets with more than `most` different spans, a bit for each of n_bits slots (`_slot`); empty if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.chunks(batches):
            pieces = []
            for key, text in zip(_ids(batch.column(0)).tolist(), texts, strict=True):
                if text is None or len(text) < length:
                    continue
                for k, s in enumerate(range(0, len(text) - length + 1, PIECE)):
                    if ((key * 0x9E3779B97F4A7C15 + k * 0xD6E8FEB86659FD93) >> 40) % sampled == 0:
                        pieces.append(text[s : s + PIECE + length - 1])
            if pieces:
                found = Texts(pieces)
                _, first, n, v, _ = found.runs(length, q)
                pair = np.unique(np.stack([v, found.spans(first, first + n - 1 + length)], 1), axis=0)
                v, count = np.unique(pair[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(_slot(v, n_bits).astype(np.int64)), pa.array(count)], names=["v", "slot", "n"])

    counts = common.arrow(docs, run, "v long, slot long, n long").groupBy("v", "slot").agg(F.sum("n").alias("n"))
    words = counts.where(F.col("n") > most // sampled).groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).collect()
    out = np.zeros(n_bits // 64 if words else 0, np.uint64)
    for r in words:
        out[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return out


def _slot(v: np.ndarray, n_bits: int) -> np.ndarray:
    """Each filing hash's place in the filter of hot buckets."""
    return mix(v) % np.uint64(n_bits)


def parts_of(docs: DataFrame) -> int:
    """In how many parts the buckets of docs are dealt."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))


_PACKETS = "part int, kind int, packed binary"


def _batch(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, packed = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(packed, pa.binary())], names=["part", "kind", "packed"])


def _dealt(kind: int, rows: np.ndarray, part: np.ndarray, text: np.ndarray | None = None, begin: np.ndarray | None = None, size: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes]]:
    """Packets of rows by part; with text, each row's bytes text[begin : begin + size] after them."""
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    if text is not None:
        begin, size = begin[order], size[order]
    edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(part[a]), kind, _planes(rows[a:b], b"" if text is None else text[_places(begin[a:b], size[a:b])].tobytes())


def _by_part(packets: DataFrame) -> DataFrame:
    return packets.repartition("part").sortWithinPartitions("part")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    """All packets (kind, packed) of one part after the other; input sorted by part."""
    held: list[tuple[int, bytes]] = []
    last = -1
    for batch in batches:
        for part, kind, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != last and held:
                yield held
                held = []
            last = part
            held.append((kind, raw))
    if held:
        yield held


def _found(rows: np.ndarray, v: np.ndarray | None = None) -> pa.RecordBatch:
    at = rows["at"].astype(np.int64) << 32 | rows["n"].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(rows["doc"]), pa.array(rows["crc"].astype(np.int64)), pa.array(at), pa.array(v, pa.int64()) if v is not None else pa.nulls(len(rows), pa.int64())], names=["doc", "crc", "at", "v"])


_FOUND = "doc long, crc long, at long, v long"


def first_pass(docs: DataFrame, parts: int, length: int, q: int, with_crc: bool, hot: np.ndarray) -> DataFrame:
    """(part, kind, packed): runs and windows by part of their bucket, and ranges that a buffer of texts shows to be repeated."""

    def packets(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows, fresh, later = _firsts(np.concatenate([h[0] for h in held]), "v", "span", "n")
        known = [_as_ranges(rows[later])]
        rows = rows[fresh]
        out = [*_dealt(RUNS, rows, rows["v"].astype(np.int64) % parts)]
        windows, fresh, later = _firsts(np.concatenate([h[1] for h in held]), "h", "g")
        known.append(_windows_to_ranges(windows[later]))
        out += _dealt(WINDOWS, windows[fresh], (windows["h"][fresh] % np.uint64(parts)).astype(np.int64))
        ranges = np.concatenate(known)
        if len(ranges):
            out.append((int(ranges["doc"][0]) % parts, KNOWN, _planes(ranges)))
        return _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for raw, doc, crc, offset in _segments(batches, length, with_crc):
            texts = Texts(raw)
            text, first, n, v, twice = texts.runs(length, q)
            rows = np.empty(len(first), RUN)
            rows["v"], rows["span"], rows["doc"], rows["crc"] = (v >> np.uint64(32)).astype(np.uint32), texts.spans(first, first + n - 1 + length), doc[text], crc[text]
            rows["at"], rows["n"], rows["twice"] = first - texts.start[text] + offset[text], n, twice
            is_hot = np.zeros(len(v), bool)
            if len(hot):
                slot = _slot(v, 64 * len(hot))
                is_hot = (hot[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            windows = np.zeros(0, WINDOW)
            if is_hot.any():
                at = _places(first[is_hot], n[is_hot])
                own = np.repeat(rows[is_hot], n[is_hot])
                windows = np.empty(len(at), WINDOW)
                windows["h"], windows["g"], windows["doc"], windows["crc"] = texts.spans(at, at + length), texts.second(at, at + length), own["doc"], own["crc"]
                windows["at"] = own["at"] + (at - np.repeat(first[is_hot], n[is_hot]))
            held.append((rows[~is_hot], windows))
            size += len(texts.buf)
            if size >= BUFFER:
                yield packets(held)
                held, size = [], 0
        if held:
            yield packets(held)

    return common.arrow(docs, run, _PACKETS)


def settle(packets: DataFrame) -> DataFrame:
    """(doc, crc, at, v): repeated ranges (v null) and open runs (v the half of their filing hash that is kept).

    at holds the first window and, in its low half, their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _parts(batches):
            for kind, raw in held:
                if kind == KNOWN:
                    yield _found(_rows(raw, RANGE)[0])
            windows, runs = ([_rows(raw, form)[0] for kind, raw in held if kind == wanted] for wanted, form in ((WINDOWS, WINDOW), (RUNS, RUN)))
            if windows:
                rows, _, later = _firsts(np.concatenate(windows), "h", "g")
                yield _found(_windows_to_ranges(rows[later]))
            if runs:
                rows, fresh, later = _firsts(np.concatenate(runs), "v", "span", "n")
                yield _found(_as_ranges(rows[later]))
                rows = rows[fresh]
                again = _later(rows["v"])
                rows = rows[again | np.append(again[1:], False) | (rows["twice"] > 0)]
                yield _found(_as_ranges(rows), rows["v"].astype(np.int64))

    return common.arrow(_by_part(packets), run, _FOUND)


def open_runs(texts: DataFrame, names: list[str], parts: int, length: int) -> DataFrame:
    """Packets of the open runs with their bytes.  texts has (doc, crc, text) under `names`, and `runs`, pairs (at, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, bytes]] = []
        size = 0

        def packets() -> pa.RecordBatch:
            rows, text = np.concatenate([r for r, _ in held]), np.frombuffer(b"".join(t for _, t in held), np.uint8)
            long = rows["n"].astype(np.int64) - 1 + length
            return _batch([*_dealt(RUNS, rows, rows["v"].astype(np.int64) % parts, text, np.cumsum(long) - long, long)])

        for batch in batches:
            doc, crc, text, packed = (batch.column(batch.schema.get_field_index(n)) for n in names)
            for d, c, t, pairs in zip(doc.to_pylist(), crc.to_pylist(), text.cast(pa.large_binary()), packed, strict=True):
                own = np.array([(x["at"], x["v"]) for x in pairs.as_py()], np.int64).reshape(-1, 2)
                at, n, raw = own[:, 0] >> 32, own[:, 0] & 0xFFFFFFFF, t.as_py()
                rows = np.empty(len(own), OPEN)
                rows["v"], rows["doc"], rows["crc"], rows["at"], rows["n"] = own[:, 1], d, c, at, n
                spans = [raw[a : a + k - 1 + length] for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                held.append((rows, b"".join(spans)))
                size += len(held[-1][1])
                if size >= BUFFER:
                    yield packets()
                    held, size = [], 0
        if held:
            yield packets()

    return common.arrow(texts, run, _PACKETS)


def refine(packets: DataFrame, length: int) -> DataFrame:
    """(doc, crc, at, v): repeated ranges among open runs, by sorting the suffixes of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _parts(batches):
            runs = [_rows(raw, OPEN) for _, raw in held]
            rows, spans = np.concatenate([r for r, _ in runs]), np.concatenate([s for _, s in runs])
            size = rows["n"].astype(np.int64) - 1 + length
            begin = np.cumsum(size) - size
            order = np.argsort(rows["v"], kind="stable")
            rows, begin, size = rows[order], begin[order], size[order]
            new = np.flatnonzero(~_later(rows["v"]))
            ends, before = np.append(new[1:], len(rows)), np.concatenate(([0], np.cumsum(size)))
            a = 0
            while a < len(rows):  # some buckets at a time, one at least
                k = max(np.searchsorted(before[ends], before[a] + SORTED, "right") - 1, np.searchsorted(ends, a, "right"))
                b = int(ends[k])
                yield _found(repeated_windows(rows[a:b], spans[_places(begin[a:b], size[a:b])], before[a:b] - before[a], length))
                a = b

    return common.arrow(_by_part(packets), run, _FOUND)


def _by_document(ranges: DataFrame) -> DataFrame:
    """(doc, crc, ranges): each document's ranges, merged, as packed pairs of first byte and end in windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for own in batch.column(2).to_pylist():
                at = np.sort(np.array(own, np.int64))
                first, end = at >> 32, (at >> 32) + (at & 0xFFFFFFFF)
                reach = np.maximum.accumulate(end)
                new = np.concatenate(([True], first[1:] > reach[:-1]))
                packed.append(np.column_stack([first[new], np.append(reach[:-1][new[1:]], reach[-1])]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc", "crc", "ranges"])

    # Equal rows come from repeated documents.
    return common.arrow(ranges.groupBy("doc", "crc").agg(F.collect_set("at").alias("at")), run, "doc long, crc long, ranges binary")


def _ids_repeat(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


class Keyed:
    """docs with the numbers of their documents, dealt by them; its joins read one shuffle of the texts."""

    def __init__(self, docs: DataFrame):
        if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType | T.NullType):
            raise TypeError("doc_id must be an integer column: repeats are ordered by it")
        self.names = docs.columns
        self.with_crc = _ids_repeat(docs)
        self.doc, self.crc, self.more = (common.unused(docs, n) for n in ("_doc", "_crc", "_more"))
        number = F.crc32(F.coalesce("text", F.lit("")).cast("binary")) if self.with_crc else F.lit(0).cast("long")
        self.rows = docs.withColumn(self.doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID))).withColumn(self.crc, number)

    def beside(self, side: DataFrame, how: str) -> DataFrame:
        """All columns, and side's third one as `more`; a task hashes the side's rows of its documents."""
        doc, crc, more = (F.col(a).alias(b) for a, b in zip(side.columns, (self.doc, self.crc, self.more), strict=True))
        return self.rows.join(side.select(doc, crc, more).hint("shuffle_hash"), [self.doc, self.crc], how).select(*self.names, self.doc, self.crc, self.more)

    def with_repeats(self, length: int, q: int) -> DataFrame:
        """docs beside the packed pairs (first window, end of windows) of their repeated windows, as `more`."""
        parts = parts_of(self.rows)
        rows = self.rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        settled = common.cut(settle(first_pass(rows, parts, length, q, self.with_crc, hot_buckets(rows, length, q, HOT_RUNS, SAMPLED, HOT_BITS))))
        # Equal rows come from repeated documents.
        runs = settled.where(F.col("v").isNotNull()).groupBy("doc", "crc").agg(F.collect_set(F.struct("at", "v")).alias("runs"))
        packets = open_runs(self.beside(runs, "inner"), [self.doc, self.crc, "text", self.more], parts, length)
        found = settled.where(F.col("v").isNull()).union(refine(packets, length))
        return self.beside(_by_document(found.select("doc", "crc", "at")), "left").select(*self.names, self.more)


def _covered(packed: bytes | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes [begin, end)."""
    out: list[list[int]] = []
    for first, end in np.frombuffer(packed or b"", np.int64).reshape(-1, 2).tolist():
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end - 1 + length)
        else:
            out.append([first, end - 1 + length])
    return [(a, b) for a, b in out]


def _kept(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    if not gone:
        return raw
    edges = [0, *(x for span in gone for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))


def digests(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; spans are [begin, end) of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in common.chunks(batches):
            gone = [_covered(p, length) for p in batch.column(2).to_pylist()]
            sha = [hashlib.sha256(_kept(t or b"", g)).hexdigest() for t, g in zip(raw, gone, strict=True)]
            removed = [sum(b - a for a, b in g) for g in gone]
            spans = pa.array([[x for pair in g for x in pair] for g in gone], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or b"") for t in raw], pa.int64()), pa.array(removed, pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array(sha), spans], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = Keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).with_repeats(length, q)
    return common.arrow(joined, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def remove(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """docs with repeated bytes cut out of text (null stays null; characters cut in part go), and n_chars, if there, counted anew."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch, raw in common.chunks(batches):
            texts = [None if t is None else _kept(t, _covered(p, length)).decode("utf-8", "ignore") for t, p in zip(raw, batch.column(len(names)).to_pylist(), strict=True)]
            columns = [batch.column(k) for k in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                counts = [None if t is None else len(t) for t in texts]
                columns[k] = pa.array(counts).cast(batch.column(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.withColumn("text", F.col("text").cast("string"))
    joined = Keyed(rows).with_repeats(length, q)
    return common.arrow(joined, run, common.schema_of(rows.select(*names)))
