"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A text's shingles are its runs of WORDS words (A-Z lower-cased; words are
runs of characters other than space and \\t \\n \\v \\f \\r); a text of fewer
words is one shingle, a text without words has none.  Its sketch is the K
smallest different 64-bit hashes of its shingles in ascending order.  Sketches
merge: the K smallest of two sketches together are the sketch of both texts'
shingles.  A sketch with fewer than K hashes holds the whole set.

From sketches: `resemblance` (Jaccard), `containment` and `shingle_count`.

Sketches of parts (of a text, a source, the whole table) merge by `merged`, an
aggregate: every task sends K hashes of a key at most.

`with_next` puts every document beside the one after it by descending id.  The
order is cut into ranges, each one group of a single shuffle of the texts; the
document that ends a range is sent to the next range too, so no range needs
another one's rows and no task gets all rows.  Their number follows the texts'
bytes (RANGE_BYTES each) and the session's shuffle partitions; the borders, as
many, come to the driver as two numbers each, as for any sort in Spark.

Texts: null counts as empty; two empty sketches resemble each other fully,
an empty and another not at all.  Texts are read whole.  Ids are integers.
Equal ids are ordered by the text's hash, and borders may fall between them;
null ids come last, as if they were the least number.  Rows of one id and text
are all the same; from HOT of them on they are counted first, one goes the usual
way, and the others, each followed by its like, are written out over all
partitions.  Of one row alone the next is itself.  `fingerprint` replaces
columns that are called sketch or n_shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm import common
from logspark.llm.common import let
from logspark.llm.quality_rules import words

K = 128
WORDS = 5
#: A range of ids holds about so many bytes of text; on small tables there are so many ranges to a shuffle partition.
RANGE_BYTES, RANGES_A_PARTITION = 256 << 20, 4
#: Candidates for each border; the more, the more even the ranges.
CANDIDATES = 4
#: Rows of one id and text beyond which they are counted; copies written by one task at a time; keys to broadcast at most.
HOT, COPIES, FEW = 1000, 1000, 100_000
LEAST = -(2**63)


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(w: Column, n: int = WORDS) -> Column:
    """Hashes of all runs of n words, in order; repeated ones too."""
    full = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(w[i + k] for k in range(n))))
    return F.when(F.size(w) >= n, full).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def sketch(text: Column, k: int = K, n: int = WORDS) -> Column:
    return let(words(lower(text)), lambda w: F.slice(F.sort_array(F.array_distinct(shingle_hashes(w, n))), 1, k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of hashes in both among the k smallest of either; exact if both sketches hold their whole sets."""
    both_whole = (F.size(a) < k) & (F.size(b) < k)
    union = F.sort_array(F.array_distinct(F.concat(a, b)))
    seen = let(union, lambda u: F.when(both_whole, u).otherwise(F.slice(u, 1, k)))
    ratio = let(seen, lambda u: let(F.element_at(u, -1), lambda last: F.size(F.filter(F.array_intersect(a, b), lambda x: x <= last)) / F.size(u)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(ratio)


def shingle_count(a: Column, k: int = K) -> Column:
    """Different shingles: counted below k, else (k - 1) over the share of the hash range that k hashes fill."""
    filled = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / filled)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has: the intersection, from resemblance and sizes, over a's size."""
    j, na, nb = resemblance(a, b, k), shingle_count(a, k), shingle_count(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / na))


def as_text(a: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def merged(parts: DataFrame, *keys: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """(keys, sketch) of all parts of a key together; a key whose sketches are empty or null has an empty one.

    Equal hashes meet in a shuffle by key and hash, so a hot key is spread; then every task keeps a key's k smallest
    before they are brought together by key.
    """
    hashes = parts.select(*keys, F.explode_outer(sketch_col).alias("_hash")).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_hash").asc_nulls_last()))
    least = hashes.withColumn("_place", place).where(F.col("_place") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketch_col))


def _longs(values: list[int]) -> Column:
    """One array literal, made from one string."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _borders(keys: DataFrame, n: int, ranges: int) -> list[tuple[int, int]]:
    """About ranges - 1 of the n different keys (_k, _t), evenly spread, ascending."""
    share = min(1.0, CANDIDATES * ranges / max(n, 1))
    chosen = (F.xxhash64("_t", "_k").cast("double") + 2.0**63) / 2.0**64 < share
    found = sorted((r["_k"], r["_t"]) for r in keys.where(chosen).select("_k", "_t").collect())
    step = max(1, round(len(found) / ranges))
    return found[step - 1 :: step] if ranges > 1 else []


def _places(borders: list[tuple[int, int]], top: tuple[int, int]) -> Column:
    """Ranges of a row as structs (range, extra): its own, and the one above if it ends its own; the first row ends the lowest."""
    ends = [b for b in borders if b < top]
    own_only = F.struct(F.lit(0).alias("range"), F.lit(False).alias("extra"))

    def is_key(key: Column, k: Column, t: Column) -> Column:
        return (key["_k"] == k) & (key["_t"] == t)

    def extra(condition: Column, place: Column) -> Column:
        return F.when(condition, F.struct(place.alias("range"), F.lit(True).alias("extra")))

    def placed(key: Column) -> Column:
        first = extra(is_key(key, F.lit(top[0]), F.lit(top[1])), F.lit(0))
        if not ends:
            return F.array_compact(F.array(own_only, first))
        ks, ts = _longs([k for k, _ in ends]), _longs([t for _, t in ends])

        def step(at: Column, s: Column) -> Column:
            k, t = F.get(ks, at + s - 1), F.get(ts, at + s - 1)
            return F.when((k < key["_k"]) | ((k == key["_k"]) & (t < key["_t"])), at + s).otherwise(at)

        # How many ends are below the key: found by halving, the largest step first.
        below = F.aggregate(F.array(*(F.lit(1 << b) for b in reversed(range(len(ends).bit_length())))), F.lit(0), step)

        def with_own(own: Column) -> Column:
            ended = is_key(key, F.get(ks, own), F.get(ts, own))
            return F.array_compact(F.array(F.struct(own.alias("range"), F.lit(False).alias("extra")), extra(ended, own + 1), first))

        return let(below, with_own)

    return let(F.struct("_k", "_t"), placed)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_a_range: int | None = None, hot: int = HOT) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch); next by descending id, after the last comes the first.

    rows_a_range, where given, sets the size of ranges by rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("text"))
    rows = rows.withColumns({"_k": F.coalesce(F.col("_id").cast("long"), F.lit(LEAST)), "_t": F.xxhash64("text")})
    keys = common.cut(rows.groupBy("_k", "_t").agg(F.count("*").alias("_n"), F.sum(F.octet_length("text")).alias("bytes")))
    seen = keys.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("_k", "_t")).alias("top"), F.count_if(F.col("_n") > hot).alias("hot")).first()
    if rows_a_range:
        ranges = max(1, seen["n"] // rows_a_range)
    else:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(RANGES_A_PARTITION * partitions, (seen["bytes"] or 0) // RANGE_BYTES)
    top = tuple(seen["top"]) if seen["top"] else (LEAST, LEAST)
    one = None
    if seen["hot"]:
        many = keys.where(F.col("_n") > hot).select("_k", "_t", F.lit(True).alias("_hot"))
        marked = rows.join(F.broadcast(many) if seen["hot"] <= FEW else many, ["_k", "_t"], "left")
        one = marked.where("_hot").groupBy("_id", "text", "_k", "_t").agg(F.count("*").alias("_n"))
        rows = marked.where("_hot is null").select("_id", "text", "_k", "_t").unionByName(one.drop("_n"))
    placed = rows.withColumn("_p", F.explode(_places(_borders(keys, seen["n"], ranges), top)))
    dealt = placed.select("_id", "text", "_k", "_t", F.col("_p.range").alias("_range"), F.col("_p.extra").alias("_extra")).repartition("_range")
    order = Window.partitionBy("_range").orderBy("_extra", F.desc("_k"), F.desc("_t"))
    sketched = dealt.withColumn("sketch", sketch(F.col("text")))
    paired = sketched.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    found = paired.where(~F.col("_extra")).select(F.col("_id").alias(id_col), "text", "sketch", "next_text", "next_sketch")
    if one is None:
        return found
    chunk = F.explode(F.expr(f"sequence(0, (_n - 2) div {COPIES})"))
    chunks = one.where("_n > 1").withColumn("_chunk", chunk).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_k", "_t", "_chunk")
    copies = chunks.withColumn("sketch", sketch(F.col("text"))).withColumn("_copy", F.explode(F.expr(f"sequence(1, least({COPIES}, _n - 1 - _chunk * {COPIES}))")))
    return found.unionByName(copies.select(F.col("_id").alias(id_col), "text", "sketch", F.col("text").alias("next_text"), F.col("sketch").alias("next_sketch")))


def fingerprint(docs: DataFrame, text_col: str = "text", k: int = K, n: int = WORDS) -> DataFrame:
    """docs with sketch array<bigint> and n_shingles double."""
    return docs.withColumn("sketch", sketch(F.coalesce(F.col(text_col).cast("string"), F.lit("")), k, n)).withColumn("n_shingles", shingle_count(F.col("sketch"), k))


def edited(paired: DataFrame) -> DataFrame:
    """with_next's rows with the text's last third replaced from the next text: its hash, sketch and likenesses."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    made = let(F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third)), lambda e: F.struct(F.sha2(e, 256).alias("sha"), sketch(e).alias("sketch")))
    rows = paired.withColumn("n_chars", n.cast("long")).withColumn("_made", made)
    rows = rows.withColumn("edited_sha256", F.col("_made.sha")).withColumn("edited_sketch", F.col("_made.sketch")).drop("_made")
    return rows.withColumn("near_edited", resemblance(F.col("sketch"), F.col("edited_sketch"))).withColumn("near_next", resemblance(F.col("sketch"), F.col("next_sketch")))
