"""Operator 4: hierarchical language identification with linear support vector machines.

A text's features are the hashed byte 1-, 2- and 3-grams of its lower-cased letters (square roots of
relative frequencies, unit length). The family of the language is predicted first, then machines
that were trained on one pair of languages of that family vote for the language within it. Both
levels use one-versus-one linear machines; the one with most votes wins, margins break ties. The
score is the share of the winner's logistic margins (family times language).

The machines are fitted on the driver on a bounded sample of labelled rows: the first ``PER_LANG``
rows of each language by a hash of the id, whole texts, of which only the hashed frequencies are
gathered. The model's size depends on the number of languages alone and travels with the tasks.
Prediction is one narrow pass over all whole texts.

Families are a fixed table of language codes; a code that is not in it is a family of its own.
Null texts and texts without a letter are ``und`` with score 0, as is everything when there is
nothing to learn from. Repeated rows get equal results; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import crc_mod, map_text, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most labelled rows per language that the machines learn from (a documented bound).
PER_LANG = 400
BUCKETS = 4096
UNDETERMINED = "und"

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en is lb nl no sv".split(),
    "romance": "ca es fr gl it oc pt ro".split(),
    "slavic": "be bg cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "baltic": "lt lv".split(),
    "semitic": "ar he mt".split(),
    "indic": "bn gu hi mr ne pa ur".split(),
    "turkic": "az kk tr uz".split(),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def family(code: str) -> str:
    return _FAMILY.get(code.split("-")[0].lower(), code)


def features(text: str) -> np.ndarray | None:
    """Hashed n-gram frequencies of a text's letters; None without a letter."""
    if not _LETTER.search(text):
        return None
    raw = (" " + _NOT_LETTERS.sub(" ", text.lower()) + " ").encode("utf-8")
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(256) + b[1:]
    three = two[:-1] * np.uint32(256) + b[2:]
    out = np.bincount(b, minlength=BUCKETS).astype(np.float32)
    for grams, salt in ((two, 0x9E3779B1), (three, 0x85EBCA6B)):
        out += np.bincount(((grams * np.uint32(salt)) >> np.uint32(20)).astype(np.int64), minlength=BUCKETS)
    out = np.sqrt(out)
    return out / np.linalg.norm(out)


class Machine:
    """A linear support vector machine: squared hinge loss, dual coordinate descent."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 40, seed: int = 5):
        x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
        rng = np.random.default_rng(seed)
        alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
        diagonal = (x * x).sum(1) + 0.5 / cost
        for _ in range(rounds):
            most = 0.0
            for i in rng.permutation(len(x)):
                g = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / cost
                new = max(alpha[i] - g / diagonal[i], 0.0)
                if new != alpha[i]:
                    w += (new - alpha[i]) * y[i] * x[i]
                    most = max(most, abs(new - alpha[i]))
                    alpha[i] = new
            if most < 1e-4:
                break
        self.w, self.bias = w[:-1].astype(np.float32), float(w[-1])

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.bias


class OneVersusOne:
    """Machines for every pair of classes; prediction by votes, then by the sum of margins."""

    def __init__(self, x: np.ndarray, y: list[str]):
        self.classes = sorted(set(y))
        y = np.array(y)
        self.pairs = []
        for i, a in enumerate(self.classes):
            for j in range(i):
                rows = (y == a) | (y == self.classes[j])
                self.pairs.append((i, j, Machine(x[rows], np.where(y[rows] == a, 1.0, -1.0))))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class index and confidence (0 to 1) of each row."""
        n, k = len(x), len(self.classes)
        votes, total, sure = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
        for i, j, machine in self.pairs:
            m = machine.margins(x)
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            total[:, i] += m
            total[:, j] -= m
            p = 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
            sure[:, i] += p
            sure[:, j] += 1 - p
        best = np.lexsort((total, votes), axis=1)[:, -1] if k > 1 else np.zeros(n, dtype=int)
        rows = np.arange(n)
        return best, sure[rows, best] / (k - 1) if k > 1 else np.ones(n)


class Hierarchy:
    """Families first, then the languages of the predicted family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        families = [family(c) for c in langs]
        self.top = OneVersusOne(x, families)
        self.inner = {}
        for f in self.top.classes:
            rows = [i for i, g in enumerate(families) if g == f]
            self.inner[f] = OneVersusOne(x[rows], [langs[i] for i in rows])

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        f, sure = self.top.predict(x)
        lang = [UNDETERMINED] * len(x)
        for k, name in enumerate(self.top.classes):
            rows = np.flatnonzero(f == k)
            if len(rows):
                inner = self.inner[name]
                best, p = inner.predict(x[rows])
                sure[rows] *= p
                for r, b in zip(rows, best):
                    lang[r] = inner.classes[b]
        return lang, sure


def fit(train: DataFrame, per_lang: int = PER_LANG) -> Hierarchy | None:
    """A model from at most ``per_lang`` rows (doc_id, text, lang) of each language."""

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        made = (features(t) for t in texts)
        return pd.Series([None if v is None else v.astype(np.float16).tobytes() for v in made], dtype=object)

    # the first rows of each language by hashes of id and text (equal rows are one): a partial top-k per task and
    # salt, then of all. Rows are bounded, not ids: an id that the table repeats brings no more than its share
    known = train.where("lang is not null and text is not null").withColumn("th", F.xxhash64("text"))
    salted = Window.partitionBy("lang", F.col("salt")).orderBy("h", "th", "doc_id")
    whole = Window.partitionBy("lang").orderBy("h", "th", "doc_id")
    few = (
        known.select("doc_id", "lang", "th").distinct().withColumn("h", F.xxhash64("doc_id", "th"))
        .withColumn("salt", F.pmod(F.shiftright("h", 8), F.lit(64)))
        .withColumn("r", F.row_number().over(salted)).where(F.col("r") <= per_lang)
        .withColumn("r", F.row_number().over(whole)).where(F.col("r") <= per_lang)
        .select("doc_id", "lang", "th")
    )
    few = staged(few, "language_sample")  # its size is known then, so the texts need no shuffle to meet it
    texts = known.select("doc_id", "lang", "th", "text").join(few, ["doc_id", "lang", "th"], "left_semi")
    texts = texts.groupBy("doc_id", "lang", "th").agg(F.first("text").alias("text"))
    rows = texts.select("lang", hashed("text").alias("x")).collect()
    rows = sorted((r["lang"], bytes(r["x"])) for r in rows if r["x"] is not None)
    if not rows:
        return None
    x = np.array([np.frombuffer(v, dtype=np.float16) for _, v in rows]).astype(np.float32)
    return Hierarchy(x, [c for c, _ in rows])


def predict(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document."""

    def worker():
        def work(texts):
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            for start in range(0, len(texts), 500):
                made = [(i, features(texts[i])) for i in range(start, min(start + 500, len(texts))) if texts[i] is not None]
                made = [(i, v) for i, v in made if v is not None]
                if made and model is not None:
                    got, sure = model.predict(np.array([v for _, v in made]))
                    for (i, _), c, p in zip(made, got, sure):
                        lang[i], score[i] = c, p
            return lang, score

        return work

    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return map_text(docs.select("doc_id", "text", held_out), "text", "lang_pred string, score double", worker)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict all."""
    return predict(docs, fit(docs.where(crc_mod("doc_id", 4) != 2)))
