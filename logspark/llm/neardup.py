"""MinHash near-dedup by a chosen-path set similarity join.

A document's set: the hashes of its different runs of `width` words (A-Z
lower-cased; the whole sequence if it has fewer words; none without words).
Documents with equal sets are one class; only classes are joined.  A class
has COORDS min-hash values, kept as a signature of one byte each.

Trees: at the root of each of TREES independent trees one or two coordinates
are chosen (1/similarity on average), and a class goes to the node of each
chosen coordinate's value.  Nodes are counted first; small ones (SMALL classes
at most) are compared exhaustively by their signatures: pairs that agree in
NEAR of the coordinates are candidates.  All of a node's candidates are
given out where they are few; of a dense node only the best ones, at first
(`compare`).  A node that is too large is first dealt out in pieces with some
classes in common (`pieces`), which finds the links of large groups of copies
without going down the tree.

Links (`confirm`): candidates are compared on full sets; only those that pass
are links.  Components of links are the groups, so what merely looks alike
is never grouped.

What the first look left out (`reexamine`, `across`): in dense nodes, all
candidates between different components.  In large nodes, classes outside the
node's largest component are compared with all others if they are few; else
the node branches on (`forest`): a path chooses one coordinate after another in
an order of its own, and a class follows each path of its node down to the first
branch that SMALL classes at most share.  All levels of a path come from one
sort by the signature in the path's order, so a large node is settled in one
step, whatever its size, and its paths grow with it: 1 + (n / SMALL) ** PATHS.
Where a node has few such candidates they are confirmed one by one; where it
has many, its classes' sets are brought to it and compared there (`within`).

Recall: two classes at the threshold meet in a root with probability 0.8, and
there are eight roots; signatures of pairs at the threshold fall below NEAR in
about 1 of 500.  In large nodes such a pair also has to share a path's branch
of depth d, with 0.8 ** d for each of the paths; d is log(n / SMALL) over the
log of one over the resemblance of what else is there, so that templates whose
texts resemble each other by 0.75 and more lose pairs in very large nodes.
README.md has the measured recall.

Hot groups: equal sets collapse in a partial aggregate; no node, piece or
component is gathered in one task, and joins on a class or component cut its
rows into parts (`spread_join`).  Nothing but counts comes to the driver.
Broadcast: the ids of documents in candidates, and the numbers of large nodes,
only while they are fewer than BROADCAST_ROWS; beyond that the join shuffles.

Classes are numbered by a 64-bit hash of the set.  A task holds the full sets
of two documents at a time.  Null texts and texts without words are linked
with nothing.  Rows with a null id join as any other, but give no component
its number; a component without any id has a null number and its rows are
kept.  Classes of which no row has an id are linked as others are; their sets
are read from the rows without an id.  Repeated rows are in one class, all rows with the least id are kept.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm import common
from logspark.llm.components import components, spread_join
from logspark.llm.wordscan import Words, mix

WIDTH = 5
SIMILARITY = 80
COORDS = 96
TREES = 6
SMALL = 128
#: A large node of n classes has 1 + (n / SMALL) ** PATHS paths; parts of their sorted rows have about PART rows.
PATHS, PART = 0.4, 20_000
NEAR = 0.68
HUB_ROWS = 16
#: Bytes of sets that a node may bring together; candidates of one with more are confirmed pair by pair.
NODE_BYTES = 64 << 20
BROADCAST_ROWS = 500_000

#: Bytes of a signature: the coordinates', and the size of the set.
WIDE = COORDS + 4
_RNG = np.random.default_rng(6)
_A = _RNG.integers(1, 1 << 62, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(1, 1 << 62, COORDS, dtype=np.uint64)
_STEP = _RNG.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Coordinates chosen at each root: one, and a second in every fourth tree (1 / 0.8 on average).
ROOTS = [(t, t) for t in range(TREES)] + [(t, TREES + t) for t in range(0, TREES, 4)]


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' different shingle hashes, ascending inside a text; where each text's begin, and the end."""
    words = Words(texts, lower=True)
    h, counts = words.hashes(), words.counts
    n = len(texts)
    runs = np.maximum(0, counts - width + 1)
    starts = np.repeat(words.first[:-1] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
    value = np.zeros(len(starts), np.uint64)
    for k in range(width):
        value += h[starts + k] * _STEP[k]
    owner = np.repeat(np.arange(n), runs)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            there = counts[short] > k
            whole[there] += h[words.first[:-1][short[there]] + k] * _STEP[k]
        whole += counts[short].astype(np.uint64) * _STEP[63]
        value, owner = np.concatenate([value, whole]), np.concatenate([owner, short])
    value = mix(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(n + 1))


def _class_of(value: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One number for each set of hashes that begins at `at`."""
    return mix(np.add.reduceat(mix(value ^ np.uint64(0x5DEECE66D)), at) + size.astype(np.uint64))


def scan(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, cls, sig, roots): cls null without shingles; sig a byte of each min-hash value; roots the numbers of its root nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.chunks(batches):
            value, cut = shingle_sets(texts, width)
            size = np.diff(cut)
            full = np.flatnonzero(size)
            at = cut[:-1][full]
            least = np.zeros((len(full), COORDS), np.uint64)
            cls = np.zeros(len(full), np.uint64)
            if len(full):
                for c in range(COORDS):
                    least[:, c] = np.minimum.reduceat((value * _A[c] + _B[c]) >> np.uint64(32), at)
                cls = _class_of(value, at, size[full])
            roots = np.column_stack([mix(least[:, c] + (np.uint64(t * COORDS + c + 1) << np.uint64(32))) for t, c in ROOTS]).astype(np.int64)
            sig = np.concatenate([mix(least).astype(np.uint8), size[full].astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
            of = {int(k): j for j, k in enumerate(full)}
            rows = [of.get(k) for k in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size.astype(np.int64)),
                    pa.array([None if j is None else int(cls[j].astype(np.int64)) for j in rows], pa.int64()),
                    pa.array([None if j is None else sig[j].tobytes() for j in rows], pa.binary()),
                    pa.array([None if j is None else roots[j] for j in rows], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "cls", "sig", "roots"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, n_shingles long, cls long, sig binary, roots array<long>")


def _runs(batches: Iterator[pa.RecordBatch], most: int, width: int = WIDE) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool, bool]]:
    """(node, classes, signatures, first part, last part) of sorted rows; parts have `most` rows at most, singles are left out."""
    held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    open_node: int | None = None  # a node of which a part has been given out

    def parts(node: np.ndarray, cls: np.ndarray, sig: np.ndarray, done: bool):
        nonlocal held, open_node
        edge = np.flatnonzero(node[1:] != node[:-1]) + 1
        begin, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(node)]))
        keep = len(begin) if done else len(begin) - 1
        for k in np.flatnonzero((end - begin > 1) | (begin == 0)):
            a, b = int(begin[k]), int(end[k])
            first = int(node[a]) != open_node
            if k >= keep:
                while b - a > most:  # the last node may go on in the next batch
                    yield int(node[a]), cls[a : a + most], sig[a : a + most], first, False
                    open_node, first, a = int(node[a]), False, a + most
                break
            while a < b:
                c = min(b, a + most)
                if not (first and c - a == 1):
                    yield int(node[a]), cls[a:c], sig[a:c], first, c == b
                first, a = False, c
            if open_node is not None:
                open_node = None
        if not done:
            a = int(begin[-1])
            if len(node) - a > most:
                a += (len(node) - a - 1) // most * most
            held = (node[a:], cls[a:], sig[a:])

    for batch in batches:
        if not batch.num_rows:
            continue
        node, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, width)
        if held is not None:
            node, cls, sig = np.concatenate([held[0], node]), np.concatenate([held[1], cls]), np.vstack([held[2], sig])
        yield from parts(node, cls, sig, False)
    if held is not None and len(held[0]):
        yield from parts(*held, True)


def _tree(agree: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A largest spanning forest of the pairs that agree in `least` or more; agree has -1 on its diagonal."""
    n = len(agree)
    best, source, free = np.full(n, -1), np.zeros(n, np.int64), np.ones(n, bool)
    out = []
    for _ in range(n):
        k = int(np.where(free, best, -2).argmax())
        if best[k] >= least:
            out.append((int(source[k]), k))
        free[k] = False
        closer = agree[k] > best
        best[closer], source[closer] = agree[k][closer], k
    return out


def _agree(sig: np.ndarray, similarity: int) -> np.ndarray:
    """In how many coordinates each two rows agree; -1 on the diagonal and where the sizes alone say no."""
    size = np.ascontiguousarray(sig[:, COORDS:WIDE]).view("<u4")[:, 0].astype(np.int64)
    sig = np.ascontiguousarray(sig[:, :COORDS])
    out = np.empty((len(sig), len(sig)), np.int64)
    for k in range(0, len(sig), 64):  # bounded blocks
        out[k : k + 64] = (sig[k : k + 64, None, :] == sig[None, :, :]).sum(2)
    out[100 * np.minimum.outer(size, size) < similarity * np.maximum.outer(size, size)] = -1
    np.fill_diagonal(out, -1)
    return out


def _best(agree: np.ndarray, allowed: np.ndarray, most: int) -> np.ndarray:
    """Pairs (row, other): each row's `most` best allowed others."""
    masked = np.where(allowed, agree, -2)
    order = np.argsort(-masked, axis=1, kind="stable")[:, :most]
    rows = np.repeat(np.arange(len(agree)), order.shape[1])
    pairs = np.column_stack([rows, order.ravel()])
    return pairs[allowed[pairs[:, 0], pairs[:, 1]]]


class _Pairs:
    """Collects pairs of classes, and gives out each pair once in a while, smaller class first."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.size = 0

    def put(self, cls: np.ndarray, pairs: np.ndarray) -> None:
        if len(pairs):
            self.held.append(np.sort(cls[pairs], axis=1))
            self.size += len(pairs)

    def full(self) -> bool:
        return self.size > 200_000

    def give(self) -> np.ndarray:
        pairs = np.unique(np.concatenate(self.held), axis=0) if self.held else np.zeros((0, 2), np.int64)
        self.held, self.size = [], 0
        return pairs


_COMPARED = "node long, a long, b long, sig binary"


def _compared(pairs: np.ndarray, again: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of `compare`: pairs, and the rows (node, class, signature) of nodes to look at again."""
    node = pa.array([None] * len(pairs) + [k for k, cls, _ in again for _ in cls], pa.int64())
    a = np.concatenate([pairs[:, 0], *(cls for _, cls, _ in again)])
    b = pa.array(pairs[:, 1].tolist() + [None] * sum(len(cls) for _, cls, _ in again), pa.int64())
    sig = pa.array([None] * len(pairs) + [row.tobytes() for _, _, rows in again for row in rows], pa.binary())
    return pa.RecordBatch.from_arrays([node, pa.array(a, pa.int64()), b, sig], names=["node", "a", "b", "sig"])


def compare(nodes: DataFrame, similarity: int) -> DataFrame:
    """(node, a, b, sig): candidates (a, b), and the rows (node, a, sig) of dense nodes, whose candidates aren't all given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, again = _Pairs(), []
        for node, cls, sig, _, _ in _runs(batches, 4 * SMALL):
            agree = _agree(sig, similarity)
            near = agree >= NEAR * COORDS
            if not near.any():
                continue
            found = np.argwhere(np.triu(near))
            if len(found) > 2 * len(cls):
                found = np.concatenate([np.array(_tree(agree, NEAR * COORDS)).reshape(-1, 2), _best(agree, near, 2)])
                rows = near.any(1)
                again.append((node, cls[rows], sig[rows]))
            pairs.put(cls, found)
            if pairs.full() or len(again) > 200:
                yield _compared(pairs.give(), again)
                again = []
        yield _compared(pairs.give(), again)

    return common.arrow(nodes.select("node", "cls", "sig").repartition("node").sortWithinPartitions("node", "cls"), run, _COMPARED)


def across(nodes: DataFrame, similarity: int) -> DataFrame:
    """(node, a, b): candidates (a, b) of nodes (node, cls, sig, root) between different roots, or, of nodes with many, their classes and roots."""

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root = batch.column(3).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            both = np.concatenate([np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, WIDE), root], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in both], pa.binary())], names=["node", "cls", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, many = _Pairs(), []

        def given() -> pa.RecordBatch:
            p = pairs.give()
            node = pa.array([None] * len(p) + [k for k, cls, _ in many for _ in cls], pa.int64())
            return pa.RecordBatch.from_arrays([node, pa.array(np.concatenate([p[:, 0], *(c for _, c, _ in many)]), pa.int64()), pa.array(np.concatenate([p[:, 1], *(x for _, _, x in many)]), pa.int64())], names=["node", "a", "b"])

        for node, cls, both, _, _ in _runs(beside(batches), 1 << 30, WIDE + 8):
            root = np.ascontiguousarray(both[:, WIDE:]).view("<i8")[:, 0]
            if (root == root[0]).all():
                continue
            near = (_agree(both[:, :WIDE], similarity) >= NEAR * COORDS) & (root[:, None] != root[None, :])
            rows = near.any(1)
            found = np.argwhere(np.triu(near))
            if len(found) > 2 * rows.sum() and 8 * np.ascontiguousarray(both[rows, COORDS:WIDE]).view("<u4").sum(dtype=np.int64) <= NODE_BYTES:
                many.append((node, cls[rows], root[rows]))
            else:
                pairs.put(cls, found)
            if pairs.full() or len(many) > 200:
                yield given()
                many.clear()
        yield given()

    rows = nodes.select("node", "cls", "sig", "root").repartition("node").sortWithinPartitions("node", "cls")
    return common.arrow(rows, run, "node long, a long, b long")


def within(rows: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b): links on full sets that join the roots (b) of the classes (a) of each node."""

    def joined(cls: np.ndarray, root: np.ndarray, items: list[np.ndarray]) -> list[tuple[int, int]]:
        size = np.fromiter(map(len, items), np.int64, len(items))
        starts = np.concatenate(([0], np.cumsum(size)[:-1]))
        _, codes = np.unique(np.concatenate(items), return_inverse=True)
        flag, out = np.zeros(int(codes.max()) + 1, bool), []
        for k in range(len(cls)):  # each class with those after it that aren't joined to it yet
            if (root[k:] == root[k]).all():
                continue
            own = codes[starts[k] : starts[k] + size[k]]
            flag[own] = True
            both = np.add.reduceat(flag[codes[starts[k] :]].astype(np.int64), starts[k:] - starts[k])
            flag[own] = False
            for j in k + np.flatnonzero((100 * both >= similarity * (size[k:] + size[k] - both)) & (root[k:] != root[k])):
                if root[j] != root[k]:
                    out.append((int(cls[k]), int(cls[j])))
                    root[root == root[j]] = root[k]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        last = None

        def given() -> pa.RecordBatch:
            out = joined(np.array([h[0] for h in held]), np.array([h[1] for h in held]), [np.frombuffer(h[2], np.uint64) for h in held])
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

        for batch in batches:
            for node, a, b, items in zip(*(batch.column(k) for k in range(4)), strict=True):
                if node.as_py() != last and held:
                    yield given()
                    held = []
                last = node.as_py()
                held.append((a.as_py(), b.as_py(), items.as_py()))
        if held:
            yield given()

    with_sets = rows.join(sets.select(F.col("cls").alias("a"), "items"), "a").select("node", "a", "b", "items")
    return common.arrow(with_sets.repartition("node").sortWithinPartitions("node"), run, "a long, b long")


def paths(rows: DataFrame) -> DataFrame:
    """(key, cls, size, root): rows (node, cls, sig, root, n), once for each path of their node.

    A path is the node's number and one order of all coordinates; the key is a path's hash and the signature in its order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, n = batch.column(0).to_numpy().view(np.uint64), batch.column(4).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, WIDE)
            many = np.ceil((n / SMALL) ** PATHS).astype(np.int64) + 1
            for k in range(int(many.max())):
                at = np.flatnonzero(many > k)
                path = mix(node[at] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
                key = np.concatenate([path.astype(">u8").view(np.uint8).reshape(-1, 8), np.take_along_axis(sig[at, :COORDS], _order(path), 1)], axis=1)
                size = np.ascontiguousarray(sig[at, COORDS:]).view("<u4")[:, 0].astype(np.int64)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in key], pa.binary()), batch.column(1).take(rows), pa.array(size), batch.column(3).take(rows)], names=["key", "cls", "size", "root"])

    return common.arrow(rows.select("node", "cls", "sig", "root", "n"), run, "key binary, cls long, size long, root long")


def _order(path: np.ndarray) -> np.ndarray:
    """The order of the coordinates along each path, a row a path."""
    each, which = np.unique(path, return_inverse=True)
    return np.argsort(mix(each[:, None] ^ (np.arange(1, COORDS + 1, dtype=np.uint64) << np.uint64(40))[None, :]), axis=1)[which]


def _shared(key: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many bytes at their beginning two keys share, row by row."""
    differ = key != other
    return np.where(differ.any(1), differ.argmax(1), key.shape[1])


def leaves(key: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(rows, depth) of sorted keys: rows of each leaf's prefix length.

    A leaf is the shortest prefix that SMALL rows at most share.  Rows that share bytes with the first or the last key may
    stand in a leaf that goes on in the part beside this one, where it may lie deeper: they are given at all depths from
    their own leaf's to the last one that they share with that key.  Rows with equal keys in greater number are cut into runs.
    """
    n, width = key.shape
    free, out = np.ones(n, bool), []
    step = _shared(key[1:], key[:-1])
    first, last = _shared(key, key[:1].repeat(n, 0)), _shared(key, key[-1:].repeat(n, 0))
    edge = np.maximum(np.where(first >= 8, first, 0), np.where(last >= 8, last, 0))
    for depth in range(8, width + 1):
        begin = np.concatenate(([0], np.flatnonzero(step < depth) + 1, [n]))
        size = np.repeat(np.diff(begin), np.diff(begin))
        new = free & ((size <= SMALL) | (depth == width))
        rows = np.flatnonzero(new | (~free & (edge >= depth)))
        if len(rows):
            out.append((rows, depth))
        free &= ~new
        if not (free.any() or (edge > depth).any()):
            break
    return out


def forest(rows: DataFrame, n_rows: int) -> DataFrame:
    """(node, cls, sig, root): the leaves of large nodes (node, cls, sig, root, n), all levels of a path from one sort.

    Rows are dealt by ranges of their keys, so a node of any size is cut into parts of like numbers of rows; what stands
    together under a prefix meets though a border may cut it (`leaves`).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a part of about PART rows
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        key = np.frombuffer(b"".join(table.column(0).to_pylist()), np.uint8).reshape(-1, 8 + COORDS)
        cls, root = table.column(1).to_numpy(), table.column(3).to_numpy()
        size = table.column(2).to_numpy().astype("<u4").view(np.uint8).reshape(-1, 4)
        path = np.ascontiguousarray(key[:, :8]).view(">u8")[:, 0].astype(np.uint64)
        plain = np.empty((len(key), COORDS), np.uint8)
        np.put_along_axis(plain, _order(path), key[:, 8:], 1)
        sig = np.concatenate([plain, size], axis=1)
        for at, depth in leaves(key):
            name = path[at].copy()
            for k in range(8, depth):
                name = mix(name + key[at, k].astype(np.uint64) + np.uint64(1))
            if depth == key.shape[1]:  # equal signatures, too many for one node
                _, first, which = np.unique(name, return_index=True, return_inverse=True)
                name = mix(name + ((np.arange(len(at)) - first[which]) // SMALL).astype(np.uint64))
            for k in range(0, len(at), 20_000):
                part = slice(k, k + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(name[part].astype(np.int64)), pa.array(cls[at[part]]), pa.array([x.tobytes() for x in sig[at[part]]], pa.binary()), pa.array(root[at[part]])], names=["node", "cls", "sig", "root"])

    return common.arrow(paths(rows).repartitionByRange(max(1, n_rows // PART), "key").sortWithinPartitions("key", "cls"), run, "node long, cls long, sig binary, root long")


def _sized(nodes: DataFrame) -> tuple[DataFrame, int]:
    """nodes with n, the size of the large ones (null for others), and how many are large: counted with partial sums."""
    large = common.cut(nodes.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > SMALL))
    n_large = large.count()
    return nodes.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, "node", "left"), n_large


def pieces(large: DataFrame) -> DataFrame:
    """(node, cls, sig): large nodes (with n) dealt out by the classes' hashes, some HUB_ROWS classes of a node in all its pieces.

    Classes that stand together in one node's pieces do so in another's, so that their candidates are mostly the same.
    """
    share = lambda seed: F.shiftrightunsigned(F.xxhash64("cls", F.lit(seed)), 11) / float(1 << 53)
    many = F.ceil(F.col("n") / (SMALL - HUB_ROWS)).cast("int")
    own = F.array(F.floor(share(1) * many).cast("int"))
    places = F.when(share(2) * F.col("n") < HUB_ROWS, F.sequence(F.lit(0), many - 1)).otherwise(own)
    return large.select("node", "cls", "sig", F.explode(places).alias("piece")).select(F.xxhash64("node", "piece").alias("node"), "cls", "sig")


def with_root(rows: DataFrame, root: DataFrame) -> DataFrame:
    """rows (cls, ...) with root, the component so far by root (node, root), or the class itself where it has none."""
    return rows.join(root.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def reexamine(rows: DataFrame, n_large: int) -> DataFrame:
    """(node, cls, sig, root): small nodes in which the pairs of large nodes (with n) that may matter stand together.

    What is in one component (root) needs no comparison.
    """
    by_root = rows.groupBy("node", "root").agg(F.count("*").alias("k"))
    tops = by_root.groupBy("node").agg(F.max_by("root", F.struct("k", "root")).alias("top"), (F.sum("k") - F.max("k")).alias("others"))
    tops = tops.where("others > 0")
    judged = common.cut(rows.join(F.broadcast(tops), "node") if n_large <= BROADCAST_ROWS else spread_join(rows, tops, "node", "cls"))
    block = F.pmod(F.xxhash64("node", "cls"), F.ceil(F.col("n") / SMALL)).cast("int")
    all_blocks = F.sequence(F.lit(0), F.ceil(F.col("n") / SMALL).cast("int") - 1)
    # Few outside the largest component: they go to every block, and no two of the others need to meet.  These are
    # five times the node's rows at most; a node branches where that makes less of it.
    is_few = (F.col("others") <= SMALL) | ((F.col("others") <= 4 * SMALL) & (4 * F.col("others") <= F.col("n")))
    places = F.when(F.col("root") != F.col("top"), all_blocks).otherwise(F.array(block))
    few = judged.where(is_few).select("node", "cls", "sig", "root", F.explode(places).alias("x"))
    found = few.select(F.xxhash64("node", "x").alias("node"), "cls", "sig", "root")
    rest = judged.where(~is_few).select("node", "cls", "sig", "root", "n")
    many = rest.agg(F.sum(F.ceil(F.pow(F.col("n") / SMALL, F.lit(PATHS))) + 1)).first()[0]
    return found.union(forest(rest, int(many))) if many else found


def full_sets(members: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(cls, items): the sets of the classes in members (cls, rep), read again from the document rep of each.

    Classes without a rep are sought in the rows without an id.
    """
    ids = members.where(F.col("rep").isNotNull()).select(F.col("rep").alias("doc_id"), "cls")
    bare = members.where(F.col("rep").isNull()).select("cls")
    few = members.count() <= BROADCAST_ROWS
    whole = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    texts = whole.join(F.broadcast(ids) if few else ids, "doc_id").select("text", "cls")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in common.chunks(batches):
            value, at = shingle_sets(raw, width)
            size = np.diff(at)
            cls = np.zeros(len(size), np.int64)
            if len(value):
                cls[size > 0] = _class_of(value, at[:-1][size > 0], size[size > 0]).astype(np.int64)
            asked = batch.column(1)  # null: any class
            ours = np.flatnonzero((asked.is_null().to_numpy(zero_copy_only=False) | (cls == asked.fill_null(0).to_numpy())) & (size > 0))  # an id may stand at several texts
            yield pa.RecordBatch.from_arrays([pa.array(cls[ours]), pa.array([value[at[k] : at[k + 1]].tobytes() for k in ours], pa.binary())], names=["cls", "items"])

    found = common.arrow(texts, sets, "cls long, items binary")
    if not bare.isEmpty():
        unnamed = whole.where(F.col("doc_id").isNull()).select("text", F.lit(None).cast("long").alias("cls"))
        found = found.union(common.arrow(unnamed, sets, "cls long, items binary").join(F.broadcast(bare) if few else bare, "cls", "left_semi"))
    return found.dropDuplicates(["cls"])


def confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last, known = None, np.zeros(0, np.uint64)
            for k in range(batch.num_rows):
                own = np.frombuffer(batch.column(2)[k].as_py(), np.uint64)
                if batch.column(1)[k].as_py() != last:
                    last, known = batch.column(1)[k].as_py(), np.frombuffer(batch.column(3)[k].as_py(), np.uint64)
                few, many = (own, known) if len(own) <= len(known) else (known, own)
                if 100 * len(few) < similarity * len(many):
                    continue
                at = np.searchsorted(many, few)
                both = int((many[np.minimum(at, len(many) - 1)] == few).sum())
                if 100 * both >= similarity * (len(own) + len(known) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    first = pairs.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a")
    both = first.join(sets.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")
    return common.arrow(both.select("a", "b", "x", "y"), run, "a long, b long")


def links(classes: DataFrame, docs: DataFrame, width: int, similarity: int) -> DataFrame:
    """(node, root) of the classes that are linked with another; see the module's text."""

    def sets_of(*wanted: DataFrame) -> DataFrame:
        ids = reduce(DataFrame.union, wanted).toDF("cls").distinct()
        members = common.cut(classes.select("cls", "rep").join(ids, "cls", "left_semi"))
        return common.cut(full_sets(members, docs, width))

    nodes, n_large = _sized(classes.select(F.explode("roots").alias("node"), "cls", "sig"))
    look = nodes.where(F.col("n").isNull()).select("node", "cls", "sig")
    large = nodes.where(F.col("n").isNotNull())
    seen = common.cut(compare(look.union(pieces(large)) if n_large else look, similarity))
    first = common.cut(seen.where(F.col("b").isNotNull()).select("a", "b").distinct())
    found = common.cut(confirm(first, sets_of(first.select("a"), first.select("b")), similarity))
    root = components(found)
    again = with_root(seen.where(F.col("b").isNull()).select("node", F.col("a").alias("cls"), "sig"), root).select("node", "cls", "sig", "root")
    if n_large:
        again = again.union(reexamine(common.cut(with_root(large, root)), n_large))
    left = common.cut(across(again, similarity))
    if left.isEmpty():
        return root
    pairs = common.cut(left.where(F.col("node").isNull()).select("a", "b").distinct().join(first, ["a", "b"], "left_anti"))
    many = left.where(F.col("node").isNotNull())
    sets = sets_of(pairs.select("a"), pairs.select("b"), many.select("a"))
    new = common.cut(confirm(pairs, sets, similarity).union(within(many, sets, similarity)))
    return root if new.isEmpty() else components(found.union(new))


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs."""
    seen = common.cut(scan(docs, width))
    made = seen.where(F.col("cls").isNotNull())
    classes = common.cut(made.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("sig").alias("sig"), F.any_value("roots").alias("roots")))
    root = links(classes, docs, width, similarity)
    named = root.join(classes.select(F.col("cls").alias("node"), "rep"), "node")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = spread_join(named, least, "root", "node").select(F.col("node").alias("cls"), "component_id")
    alone = classes.where("copies > 1").join(root.select(F.col("node").alias("cls")), "cls", "left_anti").select("cls", F.col("rep").alias("component_id"))
    out = spread_join(seen.select("doc_id", "n_shingles", "cls"), by_class.union(alone), "cls", "doc_id", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id").eqNullSafe(own)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """docs without the rows that near_duplicates doesn't keep.

    Rows go by id: those with a null id stay, and so do all rows of an id of which one row is kept.
    """
    judged = near_duplicates(docs.select("doc_id", "text"), width, similarity)
    gone = judged.groupBy("doc_id").agg(F.max("kept").alias("stays")).where(~F.col("stays")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")
