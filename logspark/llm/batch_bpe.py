"""Token ids of many texts at once: the tokenizers library's byte-level BPE, each word encoded once.

The texts of a batch lie in one array of bytes.  Every byte gets the class of
its character (letter, digit, white space, other), and the words of the
tokenizer's pattern are found from where classes change, all in numpy.  Arrow
numbers the distinct words; only those not met before are encoded, by tiktoken
with the same vocabulary, and the ids of all words are gathered from the table.

Texts with characters or special tokens for which this is not known to agree
with the library go to the library itself.  A text of over LONG bytes is
encoded by tiktoken alone, so that a batch's arrays stay small.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable
from functools import cached_property, lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

from logspark.llm import common
from logspark.llm.bpe import _PLAIN, printable_bytes

#: Words that one task remembers, and their bytes; the memory is emptied when full.
REMEMBERED, REMEMBERED_BYTES = 500_000, 16 << 20
LONG = common.SENT_BYTES
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE, _LETTER, _DIGIT, _OTHER, _UNKNOWN = range(5)


def _class(code: int) -> int:
    c = chr(code)
    if not _PLAIN.fullmatch(c):
        return _UNKNOWN
    return _SPACE if c.isspace() else {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(c)[0], _OTHER)


#: Class of every character that UTF-8 writes in up to two bytes, and of U+2000 to U+2FFF; of every byte taken alone.
_CLASSES = np.fromiter(map(_class, range(0x800)), np.uint8)
_CLASSES_2000 = np.fromiter(map(_class, range(0x2000, 0x3000)), np.uint8)
_BYTES = _CLASSES[:128].tobytes() + bytes([_UNKNOWN]) * 128


def classes(text: bytes) -> np.ndarray:
    """The class of each byte's character; text is UTF-8."""
    raw, found = np.frombuffer(text, np.uint8), np.frombuffer(bytearray(text.translate(_BYTES)), np.uint8)
    wide = np.flatnonzero(raw >= 0x80)
    if len(wide):
        lead = wide[(raw[wide] >= 0xC0) & (raw[wide] < 0xE0)]
        found[lead] = found[lead + 1] = _CLASSES[(raw[lead].astype(np.int64) & 0x1F) << 6 | raw[lead + 1] & 0x3F]
        lead = wide[raw[wide] == 0xE2]
        kind = _CLASSES_2000[(raw[lead + 1].astype(np.int64) & 0x3F) << 6 | raw[lead + 2] & 0x3F]
        found[lead] = found[lead + 1] = found[lead + 2] = kind
    return found


def word_starts(raw: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pattern's words begin; kind: its classes, first: the first byte of every text that has one."""
    inner = np.ones(len(raw), bool)  # not the first byte of a text
    inner[first] = False
    start = ~inner
    start[1:] |= kind[1:] != kind[:-1]
    # The last character of white space before a word is a word of its own or, if it is a blank, begins that word.
    space = kind == _SPACE
    after = np.flatnonzero(space[:-1] & ~space[1:] & inner[1:]) + 1
    start[after - 1] = True
    start[after[raw[after - 1] == 0x20]] = False
    # 's 't 'm 'd 're 've 'll, where the quote begins a word.
    quote = np.flatnonzero(raw == 0x27)
    quote = quote[start[quote]]
    one, two = (np.pad(raw, (0, 2))[quote + k] for k in (1, 2))
    same, same2 = (np.pad(inner, (0, 2))[quote + k] for k in (1, 2))
    pair = same & same2 & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
    single = same & np.isin(one, np.frombuffer(b"stmd", np.uint8))
    start[quote[single | pair] + 1] = False
    for end in (quote[single] + 2, quote[pair] + 3):
        start[end[end < len(raw)]] = True
    return start


class _Words(dict):
    """word -> its place in the table of ids."""

    def __init__(self, encode: Callable[[str], np.ndarray]):
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.ends, self.bytes = array("I"), array("q", [0]), 0

    def learn(self, words: list[bytes]) -> None:
        """Words but white space are encoded in one text, a word a line: the pattern cuts it at the same places."""
        spaces = [w for w in words if w.isspace()]
        words = [w for w in words if not w.isspace()]
        line = self.encode("\n")[0]
        ids = self.encode(b"\n".join([*words, b""]).decode()) if words else np.zeros(0, np.uint32)
        end = np.flatnonzero(ids == line)
        alone = [self.encode(w.decode()) for w in spaces]
        ends = np.append(end - np.arange(len(end)), len(ids) - len(end) + np.cumsum([len(x) for x in alone], dtype=np.int64)) + len(self.ids)
        self.update(zip([*words, *spaces], range(len(self.ends) - 1, len(self.ends) - 1 + len(ends))))
        self.ids.frombytes(np.concatenate([ids[ids != line], *alone]).astype(np.uintc).tobytes())
        self.ends.frombytes(ends.astype(np.int64).tobytes())
        self.bytes += sum(map(len, words)) + sum(map(len, spaces))

    def of(self, raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of raw that begin at begin, and how many come before each word and in all."""
        if len(self) >= REMEMBERED or self.bytes >= REMEMBERED_BYTES:
            self.forget()
        ends = np.append(begin, len(raw)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        _, cuts, text = words.dictionary.buffers()
        text, cuts = text.to_pybytes(), np.frombuffer(cuts, np.int32, len(words.dictionary) + 1).tolist()
        distinct = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        place = np.fromiter(map(self.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(missing := np.flatnonzero(place < 0)):
            new = [distinct[k] for k in missing.tolist()]
            self.learn(new)
            place[missing] = [self[w] for w in new]
        table, table_ends = np.array(self.ids, np.uint32), np.array(self.ends)
        which = words.indices.to_numpy()
        size = np.diff(table_ends)[place][which]
        before = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(table_ends[place][which] - before[:-1], size)
        at += np.arange(len(at))
        return table[at], before


class Encoder:
    """Texts -> ids, by the tokenizer file at path."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, back = spec["model"]["vocab"], printable_bytes()
        merged = [vocab[m.replace(" ", "") if isinstance(m, str) else m[0] + m[1]] for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.plain = merged == sorted(merged)  # else ids are no ranks
        if self.plain:
            ranks = {bytes(back[c] for c in token): k for token, k in vocab.items() if token not in self.special}
            # A mark that no text given to it holds; without any, the encoder would look for one at every character.
            marks = {self.special[0] if self.special else "<|none|>": max(vocab.values()) + 1}
            self.special = [*dict.fromkeys((*self.special, *marks))]
            self.fast = tiktoken.Encoding("plain", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=marks)
            self.words = _Words(lambda text: self.fast.encode_to_numpy(text, disallowed_special=()))

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.no_truncation()
        whole.no_padding()
        return whole

    def __call__(self, text: str) -> np.ndarray:
        if self.plain and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def forget(self) -> None:
        """Give up the words that are remembered: the worker process may outlive its task by many stages."""
        if self.plain:
            self.words.forget()

    def many(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text (UTF-8)."""
        if not self.plain or sum(map(len, texts)) > LONG:
            return [self(t.decode()) for t in texts]
        joined = b"".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        kind = classes(joined)
        odd = set((np.searchsorted(bounds, np.flatnonzero(kind == _UNKNOWN), "right") - 1).tolist())
        for s in self.special:
            if (mark := s.encode()) in joined:
                odd |= {k for k, t in enumerate(texts) if mark in t}
        if odd:
            rest = iter(self.many([t for k, t in enumerate(texts) if k not in odd]))
            return [self(t.decode()) if k in odd else next(rest) for k, t in enumerate(texts)]
        if not joined:
            return [np.zeros(0, np.uint32)] * len(texts)
        begin = np.flatnonzero(word_starts(raw, kind, bounds[:-1][np.diff(bounds) > 0]))
        ids, before = self.words.of(raw, begin)
        cuts = before[np.searchsorted(begin, bounds)].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
