r"""Prefix trie of conversations, built by cutting sequences at half depth.

A conversation's turns stand in the order of `turn` (null first; ties by role
and text, by their first 64 characters and then a hash).  Conversation c is
rebuilt: the first h turns of conversation c - c % GROUP as it stood, then c's
own turns after its first h, with h = crc32(c in decimal) % HEADS.  Its
sequence is the root's symbol followed by its turns (role, text); each
different prefix is a node.

The recursion.  All sequences are pieces of 2**k places.  A piece is cut at
half its depth; equal upper halves below one root are one piece, and the name
of such a prefix is the root of the lower halves that follow it.  So each level
turns pieces of 2**k places below named roots into pieces of half the size, the
upper trie's and all lower forests' in one job; pieces that are equal are one
row, with the number of their conversations and the least of them, which
stands for all.  After log2(depth) levels a piece is a node.  A prefix's name
is the exclusive or of 128-bit hashes of (place, role, text) over its places,
so that names of halves join without looking at what lies before them.

The graft.  Level by level, the largest pieces first, whatever lies in a lower
forest is summed onto the node where the forest was cut off, the last node of
an upper piece.  Such a node receives at one level only, and a node is below
each of its ancestors along one chain of cuts, so sums over whole subtrees come
about in log2(depth) steps, never by a step for each turn.

No step gathers a conversation, a node's children or its members in one task:
turns are numbered within parts of one global order, halves are made of partial
sums, joins on a parent with very many children are cut into parts, and the ids
that end at a node are written into texts of parts first and then hashed as a
stream.

Rows without conv_id belong to no conversation and are left out; null role and
text are empty; repeated rows are repeated turns.  An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm import common
from logspark.llm.components import gathered, spread_join

GROUP, HEADS = 20, 4
#: Children from which the join on their parent is cut into parts.
MANY_CHILDREN = 50_000
#: Levels of the recursion after which lineage is cut, and characters of ids hashed at a time.
LEVELS, PACKED = 4, 1 << 20
_ROOT = (0x5DEECE66D, 0x1B873593)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def heads(conv: Column) -> Column:
    """Turns that a conversation takes from its group's first one."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def _numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv, part, i: place among the conversation's turns of this part, s1, s2, words; parts: conv, part, n).

    One global order over all rows, cut into parts of even size: a conversation of very many turns lies in many parts.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("u"))
    rows = rows.select("conv", "turn", F.substring("role", 1, 64).alias("r"), F.substring("text", 1, 64).alias("t"), F.xxhash64("role", "text").alias("s1"), F.xxhash64(F.lit(7), "text", "role").alias("s2"), word_count(F.col("text")).alias("words"), "u")
    order = [F.col("turn").asc_nulls_first(), "r", "t", "s1", "u"]
    dealt = common.cut(rows).repartitionByRange(F.col("conv"), *order).withColumn("part", F.spark_partition_id())
    # The number is taken before the parts are written, after that they stay as they are.
    ranked = dealt.withColumn("i", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)))
    turns = common.cut(ranked.select("conv", "part", "i", "s1", "s2", "words"))
    return turns, turns.groupBy("conv", "part").agg(F.count("*").alias("n"))


def _symbol(place: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), place, "s1", "s2").alias(name) for seed, name in ((1, "z1"), (2, "z2"))]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv, place, z1, z2, words): place 0 is the root's, the d-th turn of the rebuilt conversation is at d."""
    turns, parts = _numbered(conversations)
    before = Window.partitionBy("conv").orderBy("part")
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    convs = parts.groupBy("conv").agg(F.sum("n").alias("n")).withColumn("h", heads(F.col("conv"))).withColumn("base", F.col("conv") - F.col("conv") % GROUP)
    sizes = convs.where("conv = base").select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    taken = convs.join(sizes, "base", "left").select("conv", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    placed = turns.join(parts.join(taken, "conv").select("conv", "part", "before", "h", "base", "taken"), ["conv", "part"]).withColumn("i", F.col("i") + F.col("before"))
    own_base = F.col("conv") == F.col("base")
    place = F.when(own_base, F.col("i")).otherwise(F.col("i") - F.col("h") + F.col("taken"))
    own = placed.where(own_base | (F.col("i") > F.col("h"))).select("conv", place.alias("place"), "s1", "s2", "words")
    first = placed.where(own_base & (F.col("i") < HEADS)).select("base", "i", "s1", "s2", "words")
    lent = taken.where("conv <> base and taken > 0").join(first, "base").where("i <= h").select("conv", F.col("i").alias("place"), "s1", "s2", "words")
    rows = own.union(lent).select("conv", F.col("place").cast("bigint").alias("place"), *_symbol(F.col("place").cast("bigint")), "words")
    roots = convs.select("conv", F.lit(0).cast("bigint").alias("place"), F.lit(_ROOT[0]).cast("bigint").alias("z1"), F.lit(_ROOT[1]).cast("bigint").alias("z2"), F.lit(0).cast("bigint").alias("words"))
    return common.cut(rows.union(roots))


def _key(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def trie(rows: DataFrame, whole: DataFrame, levels: int) -> DataFrame:
    """Nodes (key, parent, place, conv, n, words, cuts) of sequences; whole: (conv, z1, z2) of each sequence.

    cuts: for each level at which the node lies in a lower forest, the node where that forest is cut off.
    """
    no_cuts = F.array().cast("array<struct<k: int, a: bigint, b: bigint>>")
    pieces = whole.groupBy("z1", "z2").agg(F.min("conv").alias("conv"), F.count("*").alias("n"))
    zero = F.lit(0).cast("bigint")
    pieces = pieces.select(zero.alias("j"), zero.alias("r1"), zero.alias("r2"), "conv", "n", no_cuts.alias("cuts"))
    for k in range(levels, 0, -1):
        low = F.col("place").bitwiseAND(F.lit(1 << (k - 1))) != 0
        half = [F.bit_xor(F.when(low if lower else ~low, F.col(z))).alias(f"{'q' if lower else 'p'}{z[1]}") for lower in (False, True) for z in ("z1", "z2")]
        halves = rows.groupBy("conv", F.shiftright("place", k).alias("j")).agg(*half)
        cut_1, cut_2 = F.col("r1").bitwiseXOR(F.col("p1")), F.col("r2").bitwiseXOR(F.col("p2"))
        upper = F.struct((F.col("j") * 2).alias("j"), F.col("r1").alias("r1"), F.col("r2").alias("r2"), F.col("p1").alias("c1"), F.col("p2").alias("c2"), F.col("cuts").alias("cuts"))
        cuts = F.concat("cuts", F.array(F.struct(F.lit(k).alias("k"), cut_1.alias("a"), cut_2.alias("b"))))
        lower = F.struct((F.col("j") * 2 + 1).alias("j"), cut_1.alias("r1"), cut_2.alias("r2"), F.col("q1").alias("c1"), F.col("q2").alias("c2"), cuts.alias("cuts"))
        split = pieces.join(halves, ["conv", "j"]).select("conv", "n", F.explode(F.when(F.col("q1").isNull(), F.array(upper)).otherwise(F.array(upper, lower))).alias("x"))
        pieces = split.select("conv", "n", "x.*").groupBy("j", "r1", "r2", "c1", "c2").agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), F.first("cuts").alias("cuts")).drop("c1", "c2")
        if (levels - k) % LEVELS == LEVELS - 1:
            pieces = common.cut(pieces)
    found = pieces.withColumnRenamed("j", "place").join(rows, ["conv", "place"])
    name = F.struct(F.col("r1").bitwiseXOR(F.col("z1")).alias("a"), F.col("r2").bitwiseXOR(F.col("z2")).alias("b"))
    return common.cut(found.select(name.alias("key"), _key("r1", "r2").alias("parent"), "place", "conv", "n", "words", "cuts"))


def _receives(place: Column) -> Column:
    """The level at which a node receives the sum of its forests: one more than the ones that its place ends in."""
    ends = F.length(F.regexp_extract(F.bin(place), "1*$", 0))
    return (ends + 1).cast("int")


def grafted(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes (key, place, cuts, saved, leaves) with both summed over each node's subtree: (key, saved, leaves)."""
    rows = common.cut(nodes.withColumn("level", _receives(F.col("place"))))
    done: list[DataFrame] = []
    for k in range(levels, 0, -1):
        below = F.col("place").bitwiseAND(F.lit(1 << (k - 1))) != 0
        senders = reduce(DataFrame.union, [x.where(below) for x in (rows.where((F.col("level") < k) | (F.col("level") > levels)), *done)])
        onto = F.get(F.filter("cuts", lambda c: c["k"] == k), 0)
        sums = senders.groupBy(F.struct(onto["a"].alias("a"), onto["b"].alias("b")).alias("key")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        more = rows.where(F.col("level") == k).join(sums, "key", "left")
        whole = {c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0)) for c in ("saved", "leaves")}
        now = common.cut(more.select("key", "place", "cuts", *(x.alias(c) for c, x in whole.items()), "level"))
        done.append(gathered(now, now.count()))
    return reduce(DataFrame.union, [x.select("key", "saved", "leaves") for x in (rows.where(F.col("level") > levels), *done)])


def ends(whole: DataFrame) -> DataFrame:
    """(key, ends_sha256): the conversations whose sequence is the node's, ascending in decimal, joined by commas."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one node's ids, as texts of about PACKED characters at most."""
        for batch in batches:
            out: list[list] = [[], [], [], []]
            now, ids, size = None, [], 0
            for a, b, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if now != (a, b) or size > PACKED:
                    if ids:
                        for column, v in zip(out, (*now, ids[0], ",".join(map(str, ids))), strict=True):
                            column.append(v)
                    now, ids, size = (a, b), [], 0
                ids.append(c)
                size += 20
            if ids:
                for column, v in zip(out, (*now, ids[0], ",".join(map(str, ids))), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in out[:3]), pa.array(out[3], pa.string())], names=["a", "b", "first", "ids"])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for a, b, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if now == (a, b):
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "sha"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["a", "b", "sha"])

    rows = whole.select(F.col("z1").alias("a"), F.col("z2").alias("b"), "conv")
    packed = common.arrow(rows.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv"), pack, "a bigint, b bigint, first bigint, ids string")
    found = common.arrow(packed.repartition("a", "b").sortWithinPartitions("a", "b", "first"), hashed, "a bigint, b bigint, sha string")
    return found.select(_key("a", "b").alias("key"), F.col("sha").alias("ends_sha256"))


def build(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node.

    conv_id is the least member; saved_tokens sums, over a node's subtree, the words of each node's last text times
    its members but one.
    """
    rows = rebuilt(conversations)
    whole = common.cut(rows.groupBy("conv").agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2")))
    levels = int(rows.agg(F.max("place")).first()[0] or 0).bit_length()
    nodes = trie(rows, whole, levels)
    children = common.cut(nodes.groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "key"))
    most = children.agg(F.max("n_children")).first()[0] or 0
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))
    weights = {"saved": (F.col("n") - 1) * F.col("words"), "leaves": (F.col("n_children") == 0).cast("bigint")}
    totals = grafted(nodes.select("key", "place", "cuts", *(x.alias(c) for c, x in weights.items())), levels)
    above = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    found = nodes.select("key", "parent", "place", "conv", "n", "n_children").join(totals, "key").join(ends(whole), "key", "left")
    if most > MANY_CHILDREN:
        found = spread_join(found, above, "parent", "key", "left", -(-most // MANY_CHILDREN))
    else:
        found = found.join(above, "parent", "left")
    sha = F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256")
    return found.select(F.col("conv").alias("conv_id"), F.col("place").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), sha)


#: The same nodes in DuckDB, from all prefixes written out.
ORACLE = rf"""with t as materialized (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as i, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
n as (select c, count(*) as n from t group by c),
crc as (select c, n, xor(4294967295, list_reduce(list_concat([cast(4294967295 as bigint)], flatten(list_transform(string_split(cast(c as varchar), ''), lambda ch: [cast(ascii(ch) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, case when a % 2 = 1 then 3988292384 else 0 end) end)) % {HEADS} as h, c - c % {GROUP} as base from n),
k as materialized (select crc.c, crc.h, crc.base, coalesce(n.n, 0) as base_n from crc left join n on n.c = crc.base),
r as (select k.c, t.i as p, role, text from k join t on t.c = k.base where t.i < h union all select k.c, t.i - h + least(h, base_n), role, text from k join t on t.c = k.c where t.i >= h),
s as materialized (select k.c, coalesce(list({{'role': r.role, 'text': r.text}} order by p) filter (p is not null), []) as s from k left join r using (c) group by k.c),
prefixes as (select c, len(s) as n, d, s[1 : d] as key from (select c, s, unnest(range(0, len(s) + 1)) as d from s)),
nodes as materialized (select key, d, min(c) as conv_id, count(*) as n_convs, coalesce(string_agg(cast(c as varchar), ',' order by c) filter (n = d), '') as ends from prefixes group by key, d),
kids as (select key[1 : d - 1] as key, count(*) as n_children from nodes where d > 0 group by 1),
weighed as materialized (select nodes.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * coalesce(len(regexp_extract_all(key[d].text, '[^\x20\x09-\x0D]+')), 0) as saved from nodes left join kids using (key)),
sums as (select key[1 : a] as key, sum(saved) as saved, count(*) filter (n_children = 0) as n_leaves from (select key, saved, n_children, unnest(range(0, d + 1)) as a from weighed) group by 1)
select w.conv_id, w.d as depth, p.conv_id as parent_conv_id, w.n_convs, w.n_children, n_leaves, cast(sums.saved as bigint) as saved_tokens, sha256(w.ends) as ends_sha256
from weighed w join sums using (key) left join nodes p on w.d > 0 and p.key = w.key[1 : w.d - 1]"""
