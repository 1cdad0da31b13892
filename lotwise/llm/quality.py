"""Operator 3: quality rules by an isolation forest over rule statistics.

Every document gets rule statistics (words, symbols, repeated lines and windows, capitals ...). An isolation forest of random splits is grown on a bounded sample of the rows;
a document's score is 2^(-average path length / expected length), near 1 for rows that few splits set
apart. The threshold comes from labelled rows: the score histogram of good and bad labels over all
labelled documents, cut where the balanced accuracy is highest. A document that fails the base rules,
or that scores above the threshold, is rejected.

The forest (a few hundred kB) has a fixed size and travels with the tasks; the only numbers
gathered on the driver are the bounded sample of statistics and the histogram (``BINS`` rows).

Null texts have no words (all statistics 0) and fail the base rules, as do empty texts. Repeated rows
get equal results. Without labels of both kinds nothing but the base rules rejects. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.bpe_words import slices
from lotwise.llm.common import map_text, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Most rows the forest is grown from (a documented bound), trees, and rows of one tree.
SAMPLE_ROWS = 20_000
TREES = 200
TREE_ROWS = 256
SEED = 7
BINS = 10_000

FEATURES = ("symbols", "repeats", "capitals", "word_length", "exclamations", "bars")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_SPACES = np.array([9, 10, 11, 12, 13, 32])


def _repeat_words(ids: np.ndarray, base: int) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(ids) < 4:
        return 0
    keys = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    window = np.zeros(len(keys), dtype=bool)
    window[order[1:][same]] = True
    window[order[:-1][same]] = True
    word = np.zeros(len(ids), dtype=bool)
    word[:-2] |= window
    word[1:-1] |= window
    word[2:] |= window
    return int(word.sum())


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rule statistics (5 integer columns) and forest features of each text."""
    stats = np.zeros((len(texts), 5), dtype=np.int64)
    feats = np.zeros((len(texts), len(FEATURES)))
    at = 0
    for some in slices(texts):
        known: dict[bytes, int] = {}
        split = []
        for text in some:
            words = text.encode("utf-8").split()
            split.append(np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64))
        base = len(known) + 1
        for text, ids in zip(some, split):
            raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
            hist = np.bincount(raw, minlength=256)
            points = len(raw) - int(hist[128:192].sum())
            chars = points - int(hist[_SPACES].sum())
            symbols = int(hist[_SYMBOLS].sum())
            seen, dup = set(), 0
            for line in text.split("\n"):
                if line in seen:
                    dup += 1
                elif line.strip(" \t\n\r\x0b\x0c"):
                    seen.add(line)
            n, rep = len(ids), _repeat_words(ids, base)
            stats[at] = n, chars, symbols, dup, rep
            if n:
                upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
                feats[at] = (
                    symbols / chars, rep / n, upper / max(upper + lower, 1),
                    min(chars / n, 30.0), hist[33] / n, hist[124] / n,
                )
            at += 1
    return stats, feats


class Forest:
    """An isolation forest in arrays: node i splits ``feature[i]`` at ``cut[i]``, children 2i+1, 2i+2."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.tree_rows = min(tree_rows, max(len(rows), 1))
        self.depth = max(1, int(np.ceil(np.log2(max(self.tree_rows, 2)))))
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, size), -1, dtype=np.int16)
        self.cut = np.zeros((trees, size))
        self.length = np.zeros((trees, size))
        for t in range(trees):
            pick = rows[rng.choice(len(rows), self.tree_rows, replace=False)] if len(rows) else rows
            self._grow(t, 0, 0, pick, rng)

    def _grow(self, t, node, depth, rows, rng):
        varies = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
        if depth == self.depth or not len(varies):
            self.length[t, node] = depth + expected_length(len(rows))
            return
        f = int(rng.choice(varies))
        cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
        self.feature[t, node], self.cut[t, node] = f, cut
        below = rows[:, f] < cut
        self._grow(t, 2 * node + 1, depth + 1, rows[below], rng)
        self._grow(t, 2 * node + 2, depth + 1, rows[~below], rng)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, length in zip(self.feature, self.cut, self.length):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                right = rows[every, np.maximum(f, 0)] >= cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(expected_length(self.tree_rows), 1e-9))


def expected_length(n: int) -> float:
    """Average path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text), the rule statistics and the feature array of each document."""

    def worker():
        def work(texts):
            stats, feats = statistics(["" if t is None else t for t in texts])
            return [*stats.T, list(feats)]

        return work

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return map_text(keyed, "text", f"{STATS}, features array<double>", worker)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def grow(stats: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """A forest from at most ``sample_rows`` rows with words, the first by a hash of their values."""
    rows = (
        stats.where("n_words > 0").select("features")
        .orderBy(F.xxhash64("doc_id", "features"), "features").limit(sample_rows).collect()
    )
    return Forest(np.array([r[0] for r in rows]).reshape(len(rows), len(FEATURES)))


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.array(features.tolist()).reshape(len(features), len(FEATURES))))

    return stats.withColumn("score", F.when(F.col("n_words") > 0, score("features")).otherwise(F.lit(1.0)))


def threshold(scores: DataFrame, labels: DataFrame, bins: int = BINS) -> float:
    """The score above which rows are rejected: highest balanced accuracy over all labelled rows."""
    hist = (
        labels.where("quality in (0, 1)").select("doc_id", "quality")
        .join(scores.where(~base_failed()).select("doc_id", "score"), "doc_id")
        .groupBy(F.floor(F.col("score") * bins).alias("bin"))
        .agg(F.sum(F.col("quality")).alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
        .orderBy("bin").collect()
    )
    good = np.array([r["good"] for r in hist], dtype=float)
    bad = np.array([r["bad"] for r in hist], dtype=float)
    if not good.sum() or not bad.sum():
        return float("inf")
    kept_good = np.cumsum(good) / good.sum()
    caught = 1 - np.cumsum(bad) / bad.sum()
    gain = kept_good + caught
    best = np.flatnonzero(gain >= gain.max() - 1e-12)[-1]
    above = hist[best + 1]["bin"] if best + 1 < len(hist) else bins
    return (hist[best]["bin"] + 1 + above) / 2 / bins  # half way to the next score that occurs


def _verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_key, the rule statistics, base_failed, kept, score: one row per document."""
    stats = staged(with_statistics(docs), "quality_stats")
    scores = staged(scored(stats, grow(stats)).drop("features"), "quality_scores")
    limit = threshold(scores, labels)
    return scores.select(
        "doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & (F.col("score") <= limit)).alias("kept"),
        "score",
    )


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the rule statistics, base_failed, kept, score: one row per document."""
    return _verdicts(docs, labels).drop("text_key")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns (ids may be null or repeated: by id and text)."""
    verdict = _verdicts(docs, labels).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    same = docs["doc_id"].eqNullSafe(verdict["kept_id"]) & (F.xxhash64(docs["text"]) == verdict["kept_key"])
    return docs.join(verdict, same, "left_semi")
