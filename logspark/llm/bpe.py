"""BPE encoding and decoding by a tokenization automaton.

The merges of a byte-level BPE vocabulary are compiled, one gadget for
each in their order, into a deterministic automaton over tokens.  It
accepts exactly the token sequences that merging would produce:

* at first every byte leads back to one state;
* the gadget of the rule (u, v) -> w sends every arc labelled u to a copy
  of its state that lacks the arc v, and adds, where u could be read, an
  arc w to the state that v led to.

All arcs with one label end in one state, so states are known by the last
token.  The copy made by a gadget differs from its source by one missing
arc, so a state is kept as what it lacks (`lacks[u][v]`: the gadget that
removed v) and the state that it was copied from (`after`); an arc w that a
gadget adds exists where its `before` existed then.  This is linear in the
number of merges, where full arc tables would be quadratic (2.5 billion
entries for 50,000 tokens); `step` answers from it what the table lacks.

A word (the texts are split by the tokenizer's pattern first) is encoded by
table: `follow` maps (state, label) to whether there is an arc, and is filled
when an arc is first asked for.  Any prefix of a word has one accepted path,
so its state is known by its length alone; the walk takes the longest arcs
first and leaves a length for good when no arc leads on from it, so each
length is entered once and at most as many labels are tried there as the
longest has bytes.  The work is linear in the word's length.  Decoding joins
the labels of the arcs.

Texts: null counts as empty, and an empty text has no token.  Long texts
and words are read whole.
Repeated rows are encoded each.  A null id stays null.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm import common

#: Words whose tokens one worker remembers; the memory is emptied when full.
REMEMBERED = 300_000
#: Told arcs that it remembers; likewise.
STEPS = 500_000
_NEVER = 1 << 60
_NONE: list[int] = []

#: The tokenizer's split pattern where letters and digits are plain ones.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters for which Python's classes agree with the tokenizer's.
_PLAIN = re.compile("[\t\n\r -~¡-©«-±´¶-¸»¿-ɏΑ-ΡΣ-ϿА-я‐-‧‰-⁞]*")


def printable_bytes() -> dict[str, int]:
    """Byte-level vocabularies print every byte as one visible character: this maps back."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int] | None = None):
        back = printable_bytes()
        spell = lambda token: bytes(back[c] for c in token)
        size = max([*vocab.values(), *(special or {}).values()], default=-1) + 1
        self.special = special or {}
        self.labels: list[bytes] = [b""] * size
        self.before, self.after, self.born = [-1] * size, [-1] * size, [-1] * size
        self.lacks: dict[int, dict[int, int]] = {}
        self.arcs: dict[bytes, int] = {}
        #: last token << 20 | token -> whether there is that arc
        self.follow: dict[int, bool] = {}
        for token, k in vocab.items():
            self.labels[k] = spell(token)
            if len(self.labels[k]) == 1:
                self.arcs[self.labels[k]] = k
        for rank, (u, v) in enumerate(merges):
            self.gadget(rank, vocab[u], vocab[v], vocab[u + v])
        for text, k in self.special.items():
            self.labels[k] = text.encode()
        self.follow.clear()
        #: The labels as a trie: byte -> (token or -1, what may follow).
        self.trie: dict = {}
        for label, k in self.arcs.items():
            node = self.trie
            for b in label[:-1]:
                node = node.setdefault(b, [-1, {}])[1]
            node.setdefault(label[-1], [-1, {}])[0] = k
        self.length = list(map(len, self.labels))
        self.longest = max(map(len, self.arcs), default=0)

    def gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if self.labels[w] in self.arcs:
            raise ValueError(f"two rules make the token {self.labels[w]!r}")
        reached = self.labels[u] in self.arcs and self.labels[v] in self.arcs and self.exists(u, v)
        self.lacks.setdefault(u, {})[v] = rank
        if reached:
            self.before[w], self.after[w], self.born[w] = u, v, rank
            self.arcs[self.labels[w]] = w

    def exists(self, last: int, token: int) -> bool:
        """Whether the state after `last` has an arc `token`."""
        lacks, before, after, born = self.lacks, self.before, self.after, self.born
        state, copied = last, _NEVER
        while state >= 0:
            if missing := lacks.get(state):
                arc, added = token, _NEVER
                while arc >= 0:
                    # Pairs are merged from the left: the rule that joins equal tokens takes the left pair first.
                    if (rank := missing.get(arc, _NEVER)) < copied and rank <= added and rank != _NEVER:
                        return False
                    added, arc = born[arc], before[arc]
            copied, state = born[state], after[state]
        return True

    def step(self, last: int, token: int) -> bool:
        key = last << 20 | token
        known = self.follow.get(key)
        if known is None:
            if len(self.follow) >= STEPS:
                self.follow.clear()
            known = self.follow[key] = self.exists(last, token)
        return known

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        # An arc exists only for a token that merging makes, so a word that is one label is that token.
        if (whole := self.arcs.get(word)) is not None:
            return (whole,)
        n, root, told, length, most = len(word), self.trie, self.follow.get, self.length, self.longest
        path: list[int] = []
        waiting: list[list[int]] = []
        dead: set[int] = set()
        i, last = 0, -1
        while True:
            arcs, node = [], root
            for b in word[i : i + most]:
                if b not in node:
                    break
                token, node = node[b]
                if token >= 0:
                    arcs.append(token)
            while True:
                token = -1
                while arcs:
                    token = arcs.pop()
                    if (dead and i + length[token] in dead) or (last >= 0 and not ((there := told(last << 20 | token)) or (there is None and self.step(last, token)))):
                        token = -1
                        continue
                    break
                if token >= 0:
                    break
                dead.add(i)
                arcs = waiting.pop()
                i -= length[path.pop()]
                last = path[-1] if path else -1
            path.append(token)
            i += length[token]
            if i == n:
                return tuple(path)
            waiting.append(arcs or _NONE)
            last = token

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class _Remembered(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self.automaton.encode_word(word.encode())
        if len(word) <= 64:
            self[word] = out
        return out


class Tokenizer:
    """An automaton with the split into words; equal to the tokenizers library without added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.automaton = Automaton(model["vocab"], merges, special)
        self.known = _Remembered(self.automaton)
        self.names = [str(k) for k in range(len(self.automaton.labels))]
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def words(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in _pre_tokenizer().pre_tokenize_str(text)]

    def encode(self, text: str) -> list[int]:
        if self.marks is not None and self.marks.search(text):
            ids: list[int] = []
            for part in self.marks.split(text):
                if part in self.automaton.special:
                    ids.append(self.automaton.special[part])
                elif part:
                    ids += chain.from_iterable(map(self.known.__getitem__, self.words(part)))
            return ids
        return list(chain.from_iterable(map(self.known.__getitem__, self.words(text))))

    def decode(self, ids: list[int]) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _pre_tokenizer():
    """The library's own splitter, for texts with characters outside _PLAIN."""
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=True)


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    """One automaton for each worker process; its many small tables are kept from the garbage collector's rounds."""
    out = Tokenizer(path)
    gc.collect()
    gc.freeze()
    return out


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the tokens of every whole text.  path: the tokenizer's file, there on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [tokenizer.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.arrow(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, f"{id_col} {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the labels of the arcs, joined; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            texts = [None if ids is None else tokenizer.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return common.arrow(tokens.select(id_col, ids_col), run, f"{id_col} {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, digests only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        names, labels, sha = tokenizer.names.__getitem__, tokenizer.automaton.decode, lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                counts, digests, decoded = [], [], []
                for text in part.column(1).to_pylist():
                    ids = tokenizer.encode(text or "")
                    counts.append(len(ids))
                    digests.append(sha(",".join(map(names, ids)).encode()))
                    decoded.append(sha(labels(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.arrow(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
