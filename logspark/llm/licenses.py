"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences at line ends and after . ! ? ; that a blank
follows.  A sentence is normalised: A-Z lower-cased, every run of characters
other than letters and digits one blank, ends trimmed.  A normalised sentence
equal to a known licence sentence gives that sentence's identifier; a few
sentence patterns (a copyright line with any owner) give one by expression.

Before the cuts, known sentences that run over several lines, or over a cut
inside them, are put on one line: between their words any characters other
than letters and digits may stand (comment marks, too) with one line end at
most, so that none goes over a blank line.  They begin and end where a cut is.

RULES list a licence with an ordered sequence of identifiers.  A rule
matches where its identifiers appear one after the other among the
document's identified sentences; identifiers in GAPS may come between.
Longer rules are tried before shorter ones at the same place: a rule whose
match lies inside a longer match does not count.

The known sentences and rules are fixed values of this module, so their
tables are literals of the plan, bounded by the module.  No shuffle: every
row is judged from its own text.

Texts: null or empty gives no identifiers and no licences.  Texts are read
whole.  Repeated rows get equal results; rows with a null id are scanned.
Licences are sorted and distinct.  Columns of the input named like results
are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import let, unused

# Identifiers of licence sentences, and the sentences in normal form.
SENTENCES = {
    "mit-release": ["released under the mit license", "this project is licensed under the mit license", "licensed under the mit license"],
    "mit-name": ["mit license", "the mit license", "the mit license mit"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "apache-2-release": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "this work is licensed under the apache license version 2 0", "released under the apache license version 2 0"],
    "apache-2-comply": ["you may not use this file except in compliance with the license"],
    "apache-2-copy": ["you may obtain a copy of the license at"],
    "gpl-3-release": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl-2-release": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "cc-by-nc-4-release": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-4-release": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa-4-release": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"],
    "cc0-release": ["licensed under cc0 1 0", "this work has been dedicated to the public domain", "cc0 1 0 universal"],
    "bsd-redistribution": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-3-release": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license"],
    "mpl-2-release": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "rights-reserved": ["all rights reserved"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied"],
}
#: Identifiers by expression over normalised sentences.
PATTERNS = {"copyright": r"\A(?:copyright|c) (?:c )?(?:[0-9]{4} )?[^ ].*\z"}
#: May stand between the sentences of a rule.
GAPS = ("copyright", "rights-reserved", "as-is")
#: Licences and their ordered identifier sequences, the longest first.
RULES = (
    ("Apache-2.0", ("apache-2-release", "apache-2-comply", "apache-2-copy")),
    ("Apache-2.0", ("apache-2-release", "apache-2-comply")),
    ("MIT", ("mit-name", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution",)),
    ("MIT", ("mit-release",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-name",)),
    ("Apache-2.0", ("apache-2-release",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-only", ("gpl-3-release",)),
    ("GPL-2.0-only", ("gpl-2-release",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-release",)),
    ("CC-BY-4.0", ("cc-by-4-release",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-release",)),
    ("CC0-1.0", ("cc0-release",)),
    ("BSD-3-Clause", ("bsd-3-release",)),
    ("MPL-2.0", ("mpl-2-release",)),
    ("LicenseRef-AllRightsReserved", ("rights-reserved",)),
)
_CUT = r"\n|(?<=[.!?;])[ \t]+"
_WORDS = r"[^\p{L}\p{N}]+"


def normalise(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _WORDS, " "))


def _identifier(normal: Column) -> Column:
    found = None
    for name, sentences in SENTENCES.items():
        found = (F if found is None else found).when(normal.isin(sentences), name)
    for name, pattern in PATTERNS.items():
        found = found.when(normal.rlike(pattern), name)
    return found


def _hints() -> str:
    """Only sentences with one of these are normalised: each known sentence and pattern has one."""
    return r"(?i)licen|copyright|\(c\)|rights reserved|permission|redistribut|warrant|cc0|public domain|compliance|endorse"


def _wide_hints() -> str:
    """As _hints(), with any characters between two words, for texts that are not yet joined."""
    return _hints().replace(" ", _WORDS)


def _wrapped(sentences: list[str]) -> str:
    """Any of the sentences, over line ends and cuts, from one cut to the next."""
    mark = r"[^\p{L}\p{N}\n]"
    between = rf"(?:{mark}++(?:\n{mark}*+)?|\n{mark}*+)"
    longest_first = "|".join(s.replace(" ", between) for s in sorted(sentences, key=len, reverse=True))
    return rf"(?i)(?:(?<![^\n])|(?<=[.!?;])[ \t]+){mark}*(?:{longest_first})(?={mark}*?(?:\n|\z|[.!?;][ \t]))"


def joined(text: Column) -> Column:
    """The text with every known sentence on a line of its own, in normal form."""
    for sentences in SENTENCES.values():
        text = F.regexp_replace(text, _wrapped(sentences), f"\n{sentences[0]}\n")
    return text


def identifiers(text: Column) -> Column:
    """The identifiers of a text's sentences, in order."""

    def named(lines: Column) -> Column:
        raw = F.filter(F.split(lines, _CUT), lambda s: s.rlike(_hints()))
        return F.filter(F.transform(raw, lambda s: let(normalise(s), _identifier)), lambda x: x.isNotNull())

    # Few texts have a sentence to look at; the others are left after one search.
    return F.when(text.rlike(_wide_hints()), let(joined(text), named)).otherwise(F.array().cast("array<string>"))


def _joined(ids: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(ids, "|"), F.lit("|"))


def _rule(licence: str, pattern: str) -> Callable[[Column], Column]:
    def step(s: Column) -> Column:
        used = F.struct(F.regexp_replace(s["rest"], pattern, "").alias("rest"), F.array_append(s["found"], F.lit(licence)).alias("found"))
        return F.when(s["rest"].rlike(pattern), used).otherwise(s)

    return step


def licences(ids: Column) -> Column:
    """Licences whose rule matches; an identifier used by one rule is gone for the shorter rules after it."""
    gap = "(?:(?:" + "|".join(GAPS) + r")\|)*"
    state = F.struct(_joined(ids).alias("rest"), F.array().cast("array<string>").alias("found"))
    for licence, sequence in RULES:
        state = let(state, _rule(licence, r"\|" + (r"\|" + gap).join(sequence) + r"(?=\|)"))
    return F.when(F.size(ids) > 0, F.array_sort(F.array_distinct(state["found"]))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with sentence_ids array<string> (in order) and licences array<string>, in place of columns of these names."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    both = let(identifiers(text), lambda ids: F.struct(ids.alias("i"), licences(ids).alias("l")))
    made = unused(docs, "_scan")
    return docs.withColumn(made, both).withColumns({"sentence_ids": F.col(f"{made}.i"), "licences": F.col(f"{made}.l")}).drop(made)


def oracle() -> str:
    """DuckDB SQL for (doc_id, sentence_ids, licences, n_sentences), both lists joined by commas."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    case = "\n".join(f"when s in ({', '.join(map(quote, sentences))}) then '{name}'" for name, sentences in SENTENCES.items())
    case += "\n" + "\n".join(f"when regexp_matches(s, {quote(p)}) then '{name}'" for name, p in PATTERNS.items())
    gap = "(?:(?:" + "|".join(GAPS) + r")\|)*"
    steps = []
    for k, (licence, sequence) in enumerate(RULES):
        # RE2 has no lookahead: the bar after the sequence is put back.
        pattern = quote(r"\|" + (r"\|" + gap).join(sequence) + r"\|")
        steps.append(f"s{k + 1} as (select doc_id, ids, regexp_replace(rest, {pattern}, '|', 'g') as rest, case when regexp_matches(rest, {pattern}) then list_append(found, '{licence}') else found end as found from s{k})")
    return f"""
with lines as (select doc_id, i, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as j
               from (select doc_id, text, row_number() over () as i from documents)),
parts as (select doc_id, j, p, x from (select doc_id, j, unnest(l) as x, generate_subscripts(l, 1) as p
          from (select doc_id, j, string_split(regexp_replace(line, '([.!?;])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) as l from lines where regexp_matches(line, '(?i)licen|copyright|\\(c\\)|rights reserved|permission|redistribut|warrant|cc0|public domain|compliance|endorse')))),
normal as (select doc_id, j, p, trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as s from parts
           where regexp_matches(x, {quote(_hints())})),
named as (select doc_id, j, p, case {case} end as id from normal),
listed as (select doc_id, list(id order by j, p) as ids from named where id is not null group by doc_id),
s0 as (select doc_id, ids, '|' || array_to_string(ids, '|') || '|' as rest, cast([] as varchar[]) as found from listed),
{", ".join(steps)}
select d.doc_id, coalesce(array_to_string(ids, ','), '') as sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') as licences, cast(coalesce(len(ids), 0) as bigint) as n_sentences
from documents d left join s{len(RULES)} using (doc_id)
"""
