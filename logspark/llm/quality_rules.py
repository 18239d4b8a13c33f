"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule has a condition under which it rejects a document, and a formula for
its work on a row.  On a sample of at most SAMPLE_ROWS documents, `plan`
finds which rules reject which rows and what each costs there, and orders
them greedily: next comes the rule with the most rejections per cost among
the rows that the rules before it let pass.  `apply` evaluates them in that
order inside one CASE WHEN, so a rule's own work (distinct words, counts of
characters) is done only on rows that passed all before it.  The order
changes the work, never the verdict.

No shuffle: every figure of a row is made from that row, with the words
bound once (`let`).  Words are runs of characters other than space and
\\t \\n \\v \\f \\r.

Texts: null counts as empty; texts with less than MIN_WORDS words fail the
base rules.  Texts are read whole.  Repeated rows get equal verdicts, rows
with a null id are judged.  An empty table gives an empty result.  Columns of
the input that have the names of results are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import let

SAMPLE_ROWS = 2000
MIN_WORDS = 50
WHITE = "[\\x20\\x09-\\x0D]+"
_WHITE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _size_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, "")).cast("long")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def repeated_words(w: Column) -> Column:
    """Words that lie in a window of three words found twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(ranked: Column) -> Column:
        same = lambda p, j: F.coalesce(F.get(ranked, j - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(ranked, j + 1)["h"] == p["h"], F.lit(False))
        spread = F.flatten(F.transform(F.filter(ranked, same), lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2)))
        return F.size(F.array_distinct(spread))

    def count(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ranked, covered))

    return F.when(F.size(w) >= 3, let(windows, count)).otherwise(0)


def duplicate_lines(text: Column) -> Column:
    """(lines with a word, those of them that equal an earlier line)."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(_WHITE_CHARS))) > 0)
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


#: What judge adds.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "rejected_by", "kept")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text, words, figures): docs' columns as one struct, the text with null as empty, its words, and what each row is asked for."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    both = let(words(t), lambda w: F.struct(w.alias("words"), repeated_words(w).cast("long").alias("rep")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), t.alias("text"), both.alias("w"), duplicate_lines(t).alias("l"))
    n, rep = F.size("w.words").cast("long"), F.col("w.rep")
    figures = {
        "n_words": n,
        "word_chars": _size_without(F.col("text"), _WHITE_CHARS).cast("long"),
        "n_symbols": (F.length("text") - _size_without(F.col("text"), SYMBOLS)).cast("long"),
        "n_dup_lines": F.col("l.dup"),
        "n_repeat_words": rep,
        "n_lines": F.col("l.n"),
        "base_failed": (n < MIN_WORDS) | (100 * rep > 50 * n),
    }
    return rows.select("row", "text", F.col("w.words").alias("words"), *(c.alias(k) for k, c in figures.items()))


@dataclass(frozen=True)
class Rule:
    """rejects: the condition; work: its cost on a row, in characters read (a figure already there costs one)."""

    name: str
    rejects: Callable[[], Column]
    work: Callable[[], Column]


def _held() -> Column:
    return F.lit(1)


def _read() -> Column:
    return 1 + F.length("text").cast("long")


def _hashed() -> Column:
    return 1 + 3 * F.col("word_chars")  # a hash, a comparison and a place in a table for each word


RULES = (
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("word_chars"), _held),
    Rule("duplicate_lines", lambda: (F.col("n_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines")), _held),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")), _held),
    Rule("few_words", lambda: 20 * F.size(F.array_distinct("words")) < F.least(F.col("n_words"), F.lit(2000)), _hashed),
    Rule("shouting", lambda: 10 * (F.length("text") - _size_without(F.col("text"), UPPER)) > 4 * F.col("word_chars"), _read),
    Rule("exclamations", lambda: 2 * (F.length("text") - _size_without(F.col("text"), "!?")) > F.col("n_words"), _read),
)


def sample(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most sample_rows rows, by hash of the text."""
    every = max(1, docs.count() // sample_rows)
    return docs.where(F.pmod(F.xxhash64(text_col), F.lit(every)) == 0).limit(sample_rows)


def plan(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """The rules by rejections per cost on these rows, each on what those before it let pass.

    One row comes back for each set of rules that reject together (2 to the number of rules at most).
    """
    bits = sum((F.when(r.rejects(), 1 << k).otherwise(0) for k, r in enumerate(rules)), F.lit(0))
    passed = measured.where(~F.col("base_failed")).withColumn("bits", bits)
    groups = passed.groupBy("bits").agg(F.count("*").alias("n"), *(F.sum(r.work()).alias(f"work{k}") for k, r in enumerate(rules))).collect()
    left, order = groups, []
    remaining = list(range(len(rules)))
    while remaining:
        gain = {k: sum(g["n"] for g in left if g["bits"] >> k & 1) / max(1, sum(g[f"work{k}"] for g in left)) for k in remaining}
        cost = {k: sum(g[f"work{k}"] for g in groups) for k in remaining}
        best = max(remaining, key=lambda k: (gain[k], -cost[k], -k))
        remaining.remove(best)
        order.append(rules[best])
        left = [g for g in left if not g["bits"] >> best & 1]
    return order


def apply(measured: DataFrame, order: list[Rule]) -> DataFrame:
    """The columns of docs, the figures, `rejected_by` (the first rule that rejects, null if none; base rules count as "base") and kept."""
    verdict = F.when(F.col("base_failed"), "base")
    for rule in order:
        verdict = verdict.when(rule.rejects(), rule.name)
    judged = measured.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())
    kept = [f.name for f in measured.schema["row"].dataType if f.name.lower() not in RESULTS]
    return judged.select(*(F.col("row").getField(c).alias(c) for c in kept), *RESULTS)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> DataFrame:
    """docs with all figures, rejected_by and kept."""
    return apply(measure(docs, text_col), plan(measure(sample(docs, text_col, sample_rows), text_col), rules))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (
  select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from d),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram
      from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)),
r as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as p
        from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g) where n > 1)
  group by doc_id),
m as (
  select doc_id, t, cast(len(w) as bigint) as n_words,
         cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
         cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
         len(l) as n_lines, len(list_distinct(w)) as n_distinct,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) as n_bang
  from w left join r using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > word_chars or (n_lines >= 4 and 2 * n_dup_lines > n_lines)
            or word_chars < 2 * n_words or word_chars > 20 * n_words or 20 * n_distinct < least(n_words, 2000)
            or 10 * n_upper > 4 * word_chars or 2 * n_bang > n_words) as kept
from b
"""
