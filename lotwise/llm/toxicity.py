"""Operator 8: toxicity by the nearest labelled examples.

Labelled rows become TF-IDF vectors in a block-max inverted index: the postings of a term are cut into
cells, one for each block of examples that has the term, and each cell keeps the largest weight of the term in
it. For a document, the blocks' upper bounds (the document's weights times the cells' maxima) are computed first; blocks
are then scored exactly from the highest bound on until no block left can reach the k-th best cosine.
The k nearest examples are therefore the exact ones. They vote with their cosine as weight (an
example far away, or a place left empty, adds little to either side); the vote is calibrated by isotonic regression of
leave-one-out votes of the examples themselves, and the ids and cosines of the nearest examples are the evidence.

The index is fitted on a bounded sample of the labelled rows (``PER_LABEL`` of each label, the first by hashes of id and
text; equal rows are one), from which word counts are gathered, not texts. All their words are terms. A
term's weight is its IDF times how well it tells the labels apart in the sample: the root of its chi-square as a share
of ``CHI2``, between ``LEAST`` and 1 (with the IDF alone, the many words that say nothing outweigh the
few that do; see the README). A document's other words count in the length of its vector, with the least
weight. Examples that share their heaviest term lie together, which keeps the maxima tight. The index travels with the
tasks; scoring is one narrow pass over all whole texts.

Null and empty texts have no neighbours: they get the calibrated score of a document without evidence, as
do texts without any indexed term. Ties between examples go to the smaller id. Without labels the score
is 0. Repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import crc_mod, map_text, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most examples of each label (a documented bound).
PER_LABEL = 1000
NEIGHBOURS = 40
BLOCK = 16
#: Blocks scored before the first look at the k-th best; once there is one, all that can still reach it follow.
FIRST = 16
#: Chi-square of full weight, and the least share of it.
CHI2 = 40.0
LEAST = 0.1
CUT = 0.7

_TERM = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter:
    """How often each word (a run of letters, lower case) occurs."""
    return Counter(_TERM.findall(text.lower())) if text else Counter()


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Index:
    """Block-max inverted index of unit TF-IDF vectors."""

    def __init__(self, ids: list[int], counts: list[Counter], labels: list[int]):
        n, toxic = len(ids), sum(labels)
        df, df_toxic = Counter(), Counter()
        for found, y in zip(counts, labels):
            df.update(found.keys())
            if y:
                df_toxic.update(found.keys())
        self.vocab = {t: i for i, t in enumerate(sorted(df))}
        telling = np.sqrt([_chi2(df_toxic[t], df[t], toxic, n) / CHI2 for t in self.vocab])
        self.weight = np.array([np.log((1 + n) / (1 + df[t])) + 1 for t in self.vocab]) * np.clip(telling, LEAST, 1)
        self.other = (np.log(1 + n) + 1) * LEAST
        vectors = [self.vector(c) for c in counts]
        heaviest = [t[np.argmax(w)] if len(t) else -1 for t, w in vectors]
        order = sorted(range(n), key=lambda i: (heaviest[i], labels[i], ids[i]))
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.labels = np.array([labels[i] for i in order], dtype=np.int64)
        self.vectors = [vectors[i] for i in order]
        self.blocks = (n + BLOCK - 1) // BLOCK
        rows = np.repeat(np.arange(n), [len(t) for t, _ in self.vectors])
        cols = np.concatenate([t for t, _ in self.vectors] + [np.zeros(0, dtype=np.int64)])
        weights = np.concatenate([w for _, w in self.vectors] + [np.zeros(0)])
        by_term = np.lexsort((rows, cols))
        self.rows, self.weights, cols = rows[by_term], weights[by_term], cols[by_term]
        cell = cols * max(1, self.blocks) + self.rows // BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell_start = np.append(first, len(cell))
        self.cell_block = cell[first] % max(1, self.blocks)
        self.cell_max = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.term_cells = np.searchsorted(cols[first], np.arange(len(self.vocab) + 1))
        self.scored = self.seen = 0  # blocks scored, and blocks there were

    def vector(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Indexed term numbers and unit TF-IDF weights."""
        t = np.fromiter(map(self.vocab.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        tf = 1 + np.log(np.fromiter(words.values(), dtype=float, count=len(words)))
        known = t >= 0
        if not known.any():
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        t, other = t[known], tf[~known] * self.other
        w = tf[known] * self.weight[t]
        return t, w / np.sqrt((w * w).sum() + (other * other).sum())

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The exact k examples of highest positive cosine (without row ``leave``), best first."""
        cosines = np.zeros(len(self.ids))
        if not len(t) or not self.blocks:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        size = self.term_cells[t + 1] - self.term_cells[t]
        cells, weight = _ranges(self.term_cells[t], size), np.repeat(w, size)
        block = self.cell_block[cells]
        bounds = np.bincount(block, self.cell_max[cells] * weight, minlength=self.blocks)
        order = np.argsort(-bounds, kind="stable")
        step, at, kth = min(FIRST, max(8, self.blocks // 8)), 0, 0.0
        while at < len(order) and bounds[order[at]] > 0 and bounds[order[at]] >= kth - 1e-12:
            chosen = np.zeros(self.blocks, dtype=bool)
            some = order[at : at + step]
            chosen[some[bounds[some] >= kth - 1e-12]] = True
            use = np.flatnonzero(chosen[block])
            here = cells[use]
            start = self.cell_start[here]
            length = self.cell_start[here + 1] - start
            posting = _ranges(start, length)
            cosines += np.bincount(self.rows[posting], self.weights[posting] * np.repeat(weight[use], length), minlength=len(cosines))
            self.scored += int(chosen.sum())
            at += step
            if leave >= 0:
                cosines[leave] = 0.0
            kth = np.partition(cosines, -k)[-k] if len(cosines) > k else 0.0
            step = len(order) if kth > 0 else 2 * step
        self.seen += self.blocks
        found = np.flatnonzero((cosines > 0) & (cosines >= kth))
        found = found[np.lexsort((self.ids[found], -np.round(cosines[found], 12)))][:k]
        return found, cosines[found]


def _chi2(a: int, d: int, toxic: int, n: int) -> float:
    """Chi-square of a term (``a`` of ``d`` documents with it are toxic) against the label."""
    b, c, e = d - a, toxic - a, n - toxic - (d - a)
    below = (a + b) * (c + e) * (a + c) * (b + e)
    return n * (a * e - b * c) ** 2 / below if below else 0.0


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the weighted non-decreasing least-squares fit of ``y`` over ``x``."""
    at, back = np.unique(x, return_inverse=True)
    w = np.bincount(back, weight)
    v = np.bincount(back, weight * y) / w
    pools: list[list] = []
    for xi, vi, wi in zip(at, v, w):
        pools.append([xi, vi, wi])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            b, a = pools.pop(), pools.pop()
            pools.append([a[0], (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2]), a[2] + b[2]])
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


class Model:
    def __init__(self, examples: list[tuple[int, Counter, int]], share: dict[int, float], k: int = NEIGHBOURS):
        """``examples``: (id, word counts, label); ``share``: rows each example of a label stands for."""
        self.k = k
        self.index = Index([i for i, _, _ in examples], [c for _, c, _ in examples], [y for _, _, y in examples])
        left_out = [self._vote(*v, leave=i) for i, v in enumerate(self.index.vectors)]
        y = self.index.labels
        weight = np.array([share[int(c)] for c in y])
        votes = np.array([v for v, _, _ in left_out])
        none = votes < 0
        self.without = float((weight * y)[none].sum() / weight[none].sum()) if none.any() else 0.0
        self.x, self.p = isotonic(votes[~none], y[~none].astype(float), weight[~none]) if (~none).any() else (np.zeros(1), np.zeros(1))

    def _vote(self, t, w, leave: int = -1):
        rows, cosines = self.index.nearest(t, w, self.k, leave)
        if not len(rows):
            return -1.0, rows, cosines
        return float((cosines * self.index.labels[rows]).sum()) / self.k, rows, cosines

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        vote, rows, cosines = self._vote(*self.index.vector(words_of(text)))
        if vote < 0:
            return self.without, [], []
        p = self.p[max(int(np.searchsorted(self.x, vote, side="right")) - 1, 0)]
        return float(p), self.index.ids[rows].tolist(), np.round(cosines, 6).tolist()


def _word_counts():
    def work(texts):
        counts = [words_of(t) for t in texts]
        return [list(c.keys()) for c in counts], [list(c.values()) for c in counts]

    return work


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """A model from the labelled rows of the learning part, ``per_label`` of each label at most.

    Rows are known by id and a hash of the text: an id that the table repeats gives no more than its share of the
    sample. Narrow rows choose the sample; only its texts are read for their word counts.
    """
    labelled = labels.where((crc_mod("doc_id", 3) != 1) & F.col("toxic").isin(0, 1)).select(
        F.col("doc_id").alias("l_id"), F.col("toxic").alias("y")).distinct()
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th")
    rows = docs.select(F.col("doc_id").alias("d_id"), text_hash).join(labelled, F.col("d_id") == F.col("l_id")).select("d_id", "th", "y").distinct()
    rows = staged(rows, "labelled")
    share, chosen = {}, []
    for y in (0, 1):
        own = rows.where(F.col("y") == y)
        few = own.orderBy(F.xxhash64("d_id", "th"), "d_id", "th").limit(per_label).collect()
        share[y] = own.count() / max(len(few), 1)
        chosen += [(r.d_id, r.th, y) for r in few]
    if not chosen:
        return None
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen, "c_id long, c_th long, y int"))  # 2 * per_label rows at most
    texts = docs.select(F.col("doc_id").alias("d_id"), text_hash, "text")
    texts = texts.join(few.select("c_id", "c_th").distinct(), F.expr("d_id = c_id and th = c_th"), "left_semi")
    counts = map_text(texts, "text", "words array<string>, counts array<long>", _word_counts).groupBy("d_id", "th").agg(
        F.first(F.struct("words", "counts")).alias("c"))
    known = {(r.d_id, r.th): Counter(dict(zip(r.c.words, r.c.counts))) for r in counts.collect()}
    return Model([(i, known[i, th], y) for i, th, y in sorted(chosen)], share)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids and cosines): one row per document."""

    def worker():
        def work(texts):
            return zip(*[model.score(t) if model is not None else (0.0, [], []) for t in texts])

        return work

    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    made = "score double, evidence_ids array<long>, evidence_cosines array<double>"
    out = map_text(docs.select("doc_id", "text", held_out), "text", made, worker)
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select("doc_id", "held_out", "score", "predicted", "evidence_ids", "evidence_cosines")
