"""Operator 6: token counts by the whole-token shortcut.

Offline, once for a vocabulary: every vocabulary string is encoded alone by the merge table, and
the strings that are one pre-token and come out as one token are proved *whole*. A document is cut
into pre-tokens; those that are whole count as one token without any merging, and only the rest
are merged: all different ones of a batch together, remembered by the task within a bound.

The vocabulary is fixed, so what is shipped to the tasks (the whole strings and the merge ranks, about
1.5 MB) does not grow with the data. One narrow pass, no shuffle.

Nulls count as empty texts; empty texts have no tokens. The strings of special tokens inside a text
are tokens, as the library has it by default. Repeated rows are counted one by one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.bpe_words import slices, units
from lotwise.llm.common import map_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The pattern that parts texts into pre-tokens (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A task's memory of counted units is emptied beyond so many entries.
MEMORY = 500_000
LIMIT = 1024


def byte_letters() -> list[str]:
    """The letter by which vocabulary files show each byte: itself if it prints, else from 256 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(spare))
        spare += b not in shown
    return out


class Merger:
    """Applies byte-pair merges to many words at once: one row per word, one column per piece."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, first_ids: list[int], merges: list[tuple[int, int, int]]):
        """``first_ids``: the id of each byte; ``merges``: (left, right, merged) ids in rank order."""
        left, right, made = np.array(merges, dtype=np.int64).reshape(-1, 3).T
        self.first = np.array(first_ids, dtype=np.int32)
        self.made = made.astype(np.int32)
        key = (left << 32) | right
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        self.keys = key[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], self.NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces left of each word (at least one byte long)."""
        out = np.empty(len(words), dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size > 64:
                out[at] = [self._long(words[i]) for i in at]
                continue
            for some in np.array_split(at, len(at) // 20_000 + 1):
                flat = np.frombuffer(b"".join([words[i] for i in some]), dtype=np.uint8)
                out[some] = self._equal(self.first[flat].reshape(len(some), size))
        return out

    def _equal(self, t: np.ndarray) -> np.ndarray:
        """Words of one length: in each round every word takes its leftmost merge of least rank."""
        left = np.full(len(t), 1, dtype=np.int64)
        row = np.arange(len(t))
        r = self.ranks(t[:, :-1], t[:, 1:]) if t.shape[1] > 1 else None
        while t.shape[1] > 1:
            j = r.argmin(1)
            least = np.take_along_axis(r, j[:, None], 1)[:, 0]
            go = least != self.NONE
            if not go.all():
                left[row[~go]] = t.shape[1]
                t, r, j, least, row = t[go], r[go], j[go], least[go], row[go]
                if not len(row):
                    return left
            n, width = t.shape
            rows = np.arange(n)
            t[rows, j] = self.made[least]
            keep = np.ones((n, width), dtype=bool)
            keep[rows, j + 1] = False
            t = t[keep].reshape(n, width - 1)
            if width == 2:
                break
            keep = np.ones((n, width - 1), dtype=bool)
            keep[rows, j] = False
            r = r[keep].reshape(n, width - 2)
            has = j > 0
            r[rows[has], j[has] - 1] = self.ranks(t[rows[has], j[has] - 1], t[rows[has], j[has]])
            has = j < width - 2
            r[rows[has], j[has]] = self.ranks(t[rows[has], j[has]], t[rows[has], j[has] + 1])
        return left

    def _long(self, word: bytes) -> int:
        """A very long word: neighbours in linked lists, possible merges in a heap."""
        parts = self.first[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = size = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids = np.array(parts)
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(self.ranks(ids[:-1], ids[1:]).tolist()) if r != self.NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= size or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.made[r]), -1
            n -= 1
            after[i] = after[j]
            if after[j] < size:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < size:
                    a, b = parts[x], parts[after[x]]
                    r = int(self.ranks(np.array([a]), np.array([b]))[0])
                    if r != self.NONE:
                        heapq.heappush(heap, (r, x, a, b))
        return n


class Counter:
    """Counts the tokens of texts. Built on the driver from a vocabulary file, shipped to tasks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        letters = byte_letters()
        self.merger = Merger([vocab[c] for c in letters], [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._start()
        self.whole = self._prove(vocab, letters)

    def _start(self):
        import regex

        self._memory: dict[str, int] = {}
        self._find = regex.compile(PATTERN).findall
        self._special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    @classmethod
    def restored(cls, state: dict, memory: dict) -> "Counter":
        """A counter from its broadcast arrays, with the memory of earlier tasks of this worker."""
        c = cls.__new__(cls)
        c.special, c.whole = state["special"], state["whole"]
        c.merger = Merger.__new__(Merger)
        vars(c.merger).update(state["merger"])
        c._start()
        c._memory = memory
        return c

    def _prove(self, vocab, letters) -> frozenset[str]:
        """Vocabulary strings (as text) that are one pre-token and one token when encoded alone."""
        back = {c: b for b, c in enumerate(letters)}
        texts = []
        for shown in vocab:
            try:
                text = bytes(back[c] for c in shown).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue  # no text by itself: never equal to a pre-token
            if shown not in self.special and self._find(text) == [text]:
                texts.append(text)
        one = self.merger.counts([t.encode("utf-8") for t in texts]) == 1
        return frozenset(t for t, ok in zip(texts, one) if ok)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Units not yet in the task's memory are cut and merged together."""
        cut, extra = [], []
        for text in texts:
            pieces = self._special.split(text) if self._special and self._special.search(text) else [text]
            cut.append([u for p in pieces for u in units(p)] if len(pieces) > 1 else units(text))
            extra.append(len(pieces) - 1)
        memory, whole = self._memory, self.whole
        if len(memory) > MEMORY:
            memory.clear()
        memory.setdefault("", 0)
        new = {u for us in cut for u in us if u not in memory}
        cuts = {u: [u] if u in whole else self._find(u) for u in new}
        rest = list({t for ts in cuts.values() for t in ts if t not in whole})
        merged = dict(zip(rest, self.merger.counts([t.encode("utf-8") for t in rest]).tolist()))
        for u, ts in cuts.items():
            memory[u] = sum([merged.get(t, 1) for t in ts])
        out = [sum(map(memory.__getitem__, us)) + x for us, x in zip(cut, extra)]
        for u in new:
            if len(u) > 64:
                del memory[u]
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a vocabulary file; proved once per driver process."""
    key = os.path.realpath(path)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(path)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per document."""
    c = counter(path)
    arrays = {"merger": {**vars(c.merger)}, "special": c.special, "whole": c.whole}
    shared = docs.sparkSession.sparkContext.broadcast(arrays)  # fixed size, see above

    def worker():
        state = shared.value  # kept by the worker between tasks, and the memory with it
        count = Counter.restored(state, state.setdefault("memory", {})).count

        def work(texts):
            texts = ["" if t is None else t for t in texts]
            return [len(t.encode("utf-8")) for t in texts], [n for some in slices(texts) for n in count(some)]

        return work

    out = map_text(docs.select("doc_id", "text"), "text", "n_bytes long, n_tokens long", worker)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
