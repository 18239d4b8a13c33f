"""Toxicity: a weighted finite-state pattern grammar over clauses.

Weighted transducers over a clause's words, composed (`compose`):

* lexicon: a word to its class (insult, threat, target, negation, reported
  speech, quote mark, other) with a weight for insults and threats;
* reported speech: inside a clause, after "said" and the like or inside
  quotes, weights fall to REPORTED;
* negation: up to SCOPE words after a negation, weights fall to NEGATED;
* target: an insult or threat up to SCOPE words after a person addressed
  counts TARGETED times;
* insult: a target right after an insult makes that insult count TARGETED
  times;
* threat: a target up to SCOPE words after a threat does the same for it;
* acceptor: adds the weights of a clause.

An arc carries two factors: one for the weight of the word read, one for that
of the insult or threat read last; composing multiplies both.

A clause ends at . ! ? ; : or at a line's end.  Only clauses that hold an
insult or a threat are walked.  A text's features are sums over its
clauses: all weights, weights of different words, the largest clause; each
as log(1 + x).  A logistic model of these three gives the score.

The insults are those of the labelled texts (at most MAX_ROWS rows, those
with the smallest hashed id): words, and beginnings of words, that are much
more frequent in texts labelled toxic.  A term's texts are counted once for
each group of near copies (texts with the same least word hash), so that a
copied text does not make all its words insults.  Seven rows in ten give
the words, the rest fit the logistic model.  A few words of each class are
given from the start.

Texts: null or empty ones have no clause and get the least score.  Texts
are read whole.  Repeated rows get equal scores, rows with a null id are
scored.  Without usable labels the given words decide alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm import common
from logspark.llm.quality_fm import labelled
from logspark.llm.wordscan import Words

#: Labelled rows used by a fit at most; they bound the terms that it may learn.
MAX_ROWS = 12000
THRESHOLD = 0.5
SCOPE = 3
REPORTED, NEGATED, TARGETED = 0.5, 0.4, 1.5
#: Characters of the beginnings that stand for all words that go on from them.
STEMS = (4, 5, 6, 7, 8, 9)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
# Words given from the start.
GIVEN = {
    INSULT: "idiot moron loser scum trash stupid pathetic worthless disgusting clown imbécile salaud connard trottel dummkopf abschaum idiota imbécil estúpido basura",
    THREAT: "kill hurt destroy punish beat tuer frapper détruire töten schlagen vernichten matar golpear destruir",
    TARGET: "you your yours yourself they them he she him her tu toi vous ton ta du dich dir ihr euch tú usted vosotros ellos",
    NEGATION: "not no never neither nor without don't isn't aren't wasn't pas jamais aucun nicht kein keine nie nunca jamás ningún",
    REPORT: "said says say wrote writes told reported quoted claimed called dit disait sagte sagt schrieb dijo dice escribió",
}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»]|[.!?;:\n]")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Fst:
    """arcs[state][class] = (next state, factor of this word's weight, factor of the last weight); without an arc the state stays."""

    arcs: list[dict[int, tuple[int, float, float]]]

    def read(self, state: int, label: int) -> tuple[int, float, float]:
        return self.arcs[state].get(label, (state, 1.0, 1.0))


def _counting(trigger: int, scope: int, row: dict[int, tuple[float, float]]) -> Fst:
    """After `trigger`, classes in `row` get its factors within `scope` words; states count the words left."""
    again = (scope, 1.0, 1.0)
    arcs: list[dict[int, tuple[int, float, float]]] = [{trigger: again}]
    for left in range(1, scope + 1):
        arcs.append({label: (left - 1, *row.get(label, (1.0, 1.0))) for label in range(7)} | {trigger: (scope, *row.get(trigger, (1.0, 1.0)))})
    return Fst(arcs)


def scoped(trigger: int, factor: float, scope: int) -> Fst:
    """After `trigger`, insults and threats within `scope` words get `factor`."""
    return _counting(trigger, scope, {INSULT: (factor, 1.0), THREAT: (factor, 1.0)})


def aimed(kind: int, factor: float, scope: int) -> Fst:
    """A target within `scope` words after a word of `kind` gives that word `factor`; once, as nothing else is remembered."""
    fst = _counting(kind, scope, {TARGET: (1.0, factor)})
    other = THREAT if kind == INSULT else INSULT
    for row in fst.arcs[1:]:
        row[TARGET] = (0, 1.0, factor)
        row[other] = (0, 1.0, 1.0)  # the last weight is another's now
    return fst


def reported(factor: float) -> Fst:
    """After reported speech begins, and inside quotes, to the end of the clause or quote."""
    low = (factor, 1.0)
    said = {INSULT: (1, *low), THREAT: (1, *low)}
    quoted = {INSULT: (2, *low), THREAT: (2, *low)}
    return Fst([{REPORT: (1, 1.0, 1.0), QUOTE: (2, 1.0, 1.0)}, said, quoted | {QUOTE: (0, 1.0, 1.0)}])


def compose(first: Fst, second: Fst) -> Fst:
    """Both read the same classes; factors are multiplied.  Only pairs that can be reached are kept."""
    number = {(0, 0): 0}
    waiting, arcs = [(0, 0)], []
    while waiting:
        a, b = waiting.pop(0)
        row = {}
        for label in range(7):
            (x, f, p), (y, g, q) = first.read(a, label), second.read(b, label)
            if (x, y) not in number:
                number[x, y] = len(number)
                waiting.append((x, y))
            row[label] = (number[x, y], f * g, p * q)
        arcs.append(row)
    return Fst(arcs)


GRAMMAR = reduce(compose, (reported(REPORTED), scoped(NEGATION, NEGATED, SCOPE), scoped(TARGET, TARGETED, SCOPE), aimed(INSULT, TARGETED, 1), aimed(THREAT, TARGETED, SCOPE)))


@dataclass
class Grammar:
    """Terms with class and weight; `stems` are beginnings of words.  bias and slopes of the logistic model."""

    terms: dict[str, tuple[int, float]]
    stems: dict[str, float]
    bias: float = -4.0
    slopes: tuple[float, float, float] = (1.0, 1.0, 1.0)

    def lookup(self, word: str) -> tuple[int, float, str]:
        if (hit := self.terms.get(word)) is not None:
            return (*hit, word)
        for n in STEMS:
            if len(word) <= n:
                break
            if (weight := self.stems.get(word[:n])) is not None:
                return INSULT, weight, word
        if word in '"“”«»':
            return QUOTE, 0.0, word
        return OTHER, 0.0, word

    def clauses(self, text: str, hits: list[int]) -> Iterator[tuple[float, dict[str, float]]]:
        """(weight, weight of each word) of every clause around the hits (offsets of words)."""
        done = 0
        for at in hits:
            if at < done:
                continue
            # Successive searches look at no character twice: a clause begins where the last one ended, or later.
            start = max(done, max(text.rfind(c, done, at) for c in ".!?;:\n") + 1)
            state, total, words = 0, 0.0, {}
            last, last_weight = "", 0.0
            done = len(text)
            for m in _WORD.finditer(text, start):
                word = m[0]
                if word in ".!?;:\n":
                    done = m.end()
                    break
                kind, weight, name = self.lookup(word)
                state, factor, before = GRAMMAR.read(state, kind)
                if before != 1.0 and last:
                    total += last_weight * (before - 1)
                    words[last] = max(words[last], last_weight * before)
                if weight:
                    last, last_weight = name, weight * factor
                    total += last_weight
                    words[name] = max(words.get(name, 0.0), last_weight)
            yield total, words


class Matcher:
    """Finds insults and threats by one pattern, then walks their clauses."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        hot = [t for t, (kind, _) in grammar.terms.items() if kind in (INSULT, THREAT)]
        self.find = re.compile(r"(?<![^\W\d_])(?:(?:" + _alternatives(hot) + r")(?![^\W\d_])|(?:" + _alternatives(grammar.stems) + r")[^\W\d_])")

    def features(self, text: str | None) -> tuple[float, float, float]:
        low = (text or "").lower()
        hits = [m.start() for m in self.find.finditer(low)]
        total, largest, words = 0.0, 0.0, {}
        for weight, found in self.grammar.clauses(low, hits):
            total += weight
            largest = max(largest, weight)
            for word, w in found.items():
                words[word] = max(words.get(word, 0.0), w)
        return float(np.log1p(total)), float(np.log1p(sum(words.values()))), float(np.log1p(largest))


def _alternatives(terms) -> str:
    """Terms as one pattern, shared beginnings first, so that a position that starts no term is left at once."""
    trie: dict = {}
    for term in terms:
        node = trie
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}
    def write(node: dict) -> str:
        parts = [re.escape(c) + write(node[c]) for c in sorted(node) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in node else "(?:" + "|".join(parts) + ")"
        return body + "?" if "" in node else body

    return write(trie) or "(?!)"


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean): groups of near copies whose texts hold the term; a stem ends in *."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted: set[tuple[str, int, int]] = set()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(_LETTERS.findall((text or "").lower()))
                if not words:
                    continue
                hashed = Words([" ".join(sorted(words)).encode()]).hashes()
                group = int(hashed.min().astype(np.int64))
                terms = words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
                counted.update((t, label, group) for t in terms)
            out = list(counted)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in ((0, pa.string()), (1, pa.int32()), (2, pa.int64()))], names=["term", "label", "grp"])

    groups = common.arrow(sample, pairs, "term string, label int, grp long").distinct()
    return groups.groupBy("term").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean"))


def learn_terms(counts: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Terms with their weights: the log of how much more frequent they are in toxic texts."""
    if not toxic:
        return {}
    rate = F.log(((F.col("toxic") + 0.2) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1)))
    least = max(3, int(0.004 * toxic))
    rows = counts.where(F.col("toxic") >= least).withColumn("weight", rate).where((F.col("weight") > 1.6) & (F.col("toxic") > 2 * F.col("clean"))).collect()
    found = {r["term"]: (r["toxic"], float(r["weight"])) for r in sorted(rows, key=lambda r: (-r["weight"], r["term"]))}  # bounded by the sample
    longer: dict[str, int] = {}  # the most texts of a longer term, by its beginnings
    for term, (n, _) in found.items():
        for k in STEMS:
            if len(term.rstrip("*")) > k:
                longer[term[:k]] = max(n, longer.get(term[:k], 0))
    # A stem that one longer term explains says no more than that term.
    return {t: w for t, (n, w) in found.items() if not t.endswith("*") or longer.get(t[:-1], 0) < 0.9 * n}


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = 5, held_out: int = 0, rows: int = MAX_ROWS) -> Grammar:
    """Learn from labelled rows whose crc32(doc_id) mod folds is not held_out."""
    sample = common.cut(labelled(docs, labels, column, folds, held_out, rows).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(10))))
    words, rest = sample.where("part < 7").select("text", "label"), sample.where("part >= 7").select("text", "label")
    n = {r["label"]: r["count"] for r in words.groupBy("label").count().collect()}
    learned = learn_terms(term_counts(words), n.get(1, 0), n.get(0, 0))
    grammar = Grammar({}, {})
    for kind, given in GIVEN.items():
        grammar.terms |= {w: (kind, 3.0 if kind in (INSULT, THREAT) else 0.0) for w in given.split()}
    for term, weight in learned.items():
        if term.endswith("*"):
            grammar.stems[term[:-1]] = weight
        elif grammar.terms.get(term, (INSULT, 0))[0] in (INSULT, THREAT):
            grammar.terms[term] = (INSULT, weight)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(grammar)
        for batch in batches:
            found = [matcher.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.float64()) for k in range(3)] + [batch.column(1)], names=["a", "b", "c", "label"])

    seen = common.arrow(rest, features, "a double, b double, c double, label int").toPandas()
    grammar.bias, grammar.slopes = logistic(seen[["a", "b", "c"]].to_numpy(), seen["label"].to_numpy(dtype=float))
    return grammar


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[float, float, float]]:
    """Ridge logistic regression by Newton's steps, halved until the loss falls."""
    if not len(y) or y.min() == y.max():
        return -4.0, (1.0, 1.0, 1.0)
    design = np.column_stack([np.ones(len(y)), x])
    beta, ridge = np.zeros(4), np.diag([1e-3, 0.1, 0.1, 0.1])

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * b @ ridge @ b)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (p - y) + ridge @ beta)
        size = 1.0
        while size > 1e-4 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return float(beta[0]), tuple(float(b) for b in beta[1:])


def score(docs: DataFrame, grammar: Grammar, keep: list[str] | None = None, threshold: float = THRESHOLD, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns `keep` (by default all) with a score double and a prediction int named `out`; of equal names, the new columns stay."""
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in [o.lower() for o in out]]
    text = common.unused(docs, "scored_text")
    rows = docs.select(*names, F.col("text").cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(grammar)
        slopes = np.array(grammar.slopes)
        for batch in batches:
            found = np.array([matcher.features(t) for t in batch.column(len(names)).to_pylist()]).reshape(-1, 3)
            s = 1 / (1 + np.exp(-np.clip(grammar.bias + found @ slopes, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, *out])

    return common.arrow(rows, run, common.schema_of(rows.select(*names), f"`{out[0]}` double, `{out[1]}` int"))
