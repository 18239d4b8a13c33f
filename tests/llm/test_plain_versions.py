"""Language profiles and the toxicity grammar against plain versions."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from logspark.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.001"


# --- language ID ---------------------------------------------------------------


def gram_counts(text):
    chars, n = [0], collections.Counter()
    for ch in text.lower() + "\n":
        c = ord(ch) if ch.isalpha() else 0
        if c or chars[-1]:
            chars.append(c)
    for k, c in enumerate(chars):
        if c:
            n[c] += 1
        if k + 1 < len(chars):
            n[c | chars[k + 1] << 21] += 1
        if k + 2 < len(chars) and chars[k + 1]:
            n[c | chars[k + 1] << 21 | chars[k + 2] << 42] += 1
    return n


def ranks(counts):
    return {gram: place for place, (gram, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: langid.TOP])}


def test_prediction_equals_a_plain_out_of_place_loop(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"], t["lang"], strict=True))
    own = {d: gram_counts(text or "") for d, text, _ in rows}
    together = collections.defaultdict(collections.Counter)
    for d, _, lang in rows:
        if lang is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            together[lang].update(own[d])
    profiles = {lang: ranks(n) for lang, n in together.items()}
    found = {r["doc_id"]: r for r in queries.op3_language_id(spark, SF).collect()}
    assert len(found) == len(rows)
    for d, _, _ in rows:
        r, mine = found[d], ranks(own[d])
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        if not mine:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        far = {lang: sum(abs(known[g] - k) if g in known else langid.TOP for g, k in mine.items()) for lang, known in profiles.items()}
        nearest = min(far, key=lambda lang: (far[lang], lang))
        assert r["lang_pred"] == nearest
        assert r["score"] == pytest.approx(1 - far[nearest] / (langid.TOP * len(mine)), abs=1e-12)


# --- toxicity ------------------------------------------------------------------

SINGLE = (
    toxicity.reported(toxicity.REPORTED),
    toxicity.scoped(toxicity.NEGATION, toxicity.NEGATED, toxicity.SCOPE),
    toxicity.scoped(toxicity.TARGET, toxicity.TARGETED, toxicity.SCOPE),
    toxicity.aimed(toxicity.INSULT, toxicity.TARGETED, 1),
    toxicity.aimed(toxicity.THREAT, toxicity.TARGETED, toxicity.SCOPE),
)


def test_composed_machine_equals_the_single_ones_in_turn():
    rng = random.Random(2)
    for _ in range(500):
        state, states = 0, [0] * len(SINGLE)
        for _ in range(30):
            label = rng.randrange(7)
            now, last = 1.0, 1.0
            for k, machine in enumerate(SINGLE):
                states[k], f, p = machine.read(states[k], label)
                now, last = now * f, last * p
            state, f, p = toxicity.GRAMMAR.read(state, label)
            assert (f, p) == pytest.approx((now, last))


TERMS = {"idiot": (toxicity.INSULT, 3.0), "kill": (toxicity.THREAT, 2.5), "you": (toxicity.TARGET, 0.0), "not": (toxicity.NEGATION, 0.0), "said": (toxicity.REPORT, 0.0)}
KINDS = {word: kind for word, (kind, _) in TERMS.items()} | {"grumbler": toxicity.INSULT, '"': toxicity.QUOTE}
WEIGHTS = {"idiot": 3.0, "kill": 2.5, "grumbler": 2.0}


def plain_clause(words):
    """Final weight of each insult or threat of a clause, by the rules as the module states them; no machine."""
    kinds = [KINDS.get(w, toxicity.OTHER) for w in words]
    hot = (toxicity.INSULT, toxicity.THREAT)
    said = quoted = False
    weights = {}
    for k, kind in enumerate(kinds):
        if kind in hot:
            near = kinds[max(0, k - toxicity.SCOPE) : k]
            weight = WEIGHTS[words[k]]
            weight *= toxicity.REPORTED if said or quoted else 1
            weight *= toxicity.NEGATED if toxicity.NEGATION in near else 1
            weight *= toxicity.TARGETED if toxicity.TARGET in near else 1
            for j in range(k + 1, min(len(kinds), k + 1 + (1 if kind == toxicity.INSULT else toxicity.SCOPE))):
                if kinds[j] in hot:
                    break
                if kinds[j] == toxicity.TARGET:
                    weight *= toxicity.TARGETED
                    break
            weights[k] = weight
        elif kind == toxicity.REPORT and not quoted:
            said = True
        elif kind == toxicity.QUOTE and not said:
            quoted = not quoted
    return weights


def test_features_equal_a_plain_reading_of_the_rules():
    matcher = toxicity.Matcher(toxicity.Grammar(dict(TERMS), {"grumb": 2.0}))
    rng = random.Random(5)
    pool = [*KINDS, "idiot", "kill", "you", "nice", "words", "of", ".", ";", "\n"]
    for _ in range(800):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(40)))
        total, largest, best = 0.0, 0.0, {}
        for clause in re.split(r"[.;\n]", text):
            words = clause.split()
            weights = plain_clause(words)
            total, largest = total + sum(weights.values()), max(largest, sum(weights.values()))
            for k, weight in weights.items():
                best[words[k]] = max(best.get(words[k], 0.0), weight)
        assert matcher.features(text) == pytest.approx((np.log1p(total), np.log1p(sum(best.values())), np.log1p(largest))), text


def test_context_changes_the_verdict(spark):
    grammar = toxicity.Grammar({w: (kind, 3.0 if kind in (toxicity.INSULT, toxicity.THREAT) else 0.0) for kind, given in toxicity.GIVEN.items() for w in given.split()}, {"grumb": 2.0})
    texts = {
        "an idiot lives here": 1,
        "he is not an idiot": 0,
        'the sign reads "idiot" in red': 0,
        "somebody wrote that an idiot lives here": 0,
        "a grumbler lives here": 0,
        "you grumbler": 1,
        "they will kill time, not words": 1,
        "never kill time": 0,
        "you and we met. a grumbler lives here": 0,
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["text"]: r["predicted"] for r in toxicity.score(docs, grammar).collect()}
    assert found == texts
