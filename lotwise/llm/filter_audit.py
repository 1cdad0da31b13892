"""Operator 13: how five filters act on each other, for every order of applying them.

A document fails a set of filters, its mask (5 bits). Documents of a part with one mask are one cell, so a
part is at most 32 cells, whatever its size. ``gray_walk`` visits the 32 subsets of filters in Gray-code order:
each step switches one filter on or off, every cell that fails it counts its active failures up or down,
and a cell that gets its first (or loses its last) active failure leaves (or joins) the running
survivors. The survivors of the 32 subsets are stored; whatever any of the 120 orders does at any
step is a difference of two of them.

Filters, on whole texts (null: empty; words: maximal runs of characters other than ASCII white space):
A under 50 words; B 100 * distinct words < 65 * words; C 100 * characters A-Z > 5 * code points; D holds one
of ``#$%&*|``; E the same text as a smaller doc_id's anywhere in the table. Equal texts are known by a 128-bit digest.

E without hot groups: rows are first counted per (text, part, labels, id), then per (text, part, labels),
both with partial sums on the map side; what remains of a text, however often it is copied, is one row
per part and labels, and only these rows meet in one window.

A null doc_id has no labels, is smaller than no id and larger than none, so it never fails E. A row that repeats
an id and its text fails E only if a smaller id has the text too. Labels repeated for an id count if any of
them is 1. A null source is the part ''. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import string
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import map_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 50, 65, 5
SYMBOLS = re.compile(r"[#$%&*|]")
_UPPER = string.ascii_uppercase.encode()
_E = 16

REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_mask(text: str) -> int:
    """Which of the filters A to D a text fails, as bits 1, 2, 4, 8."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are cut at ASCII white space only
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
        | (100 * upper > MAX_UPPER * len(text)) << 2
        | (SYMBOLS.search(text) is not None) << 3
    )


def _masks():
    def work(texts):
        whole = [t or "" for t in texts]
        return [text_mask(t) for t in whole], [
            hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in whole]

    return work


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, and how many are labelled."""
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), "text")
    rows = map_text(rows, "text", "mask int, digest binary", _masks)
    # rows without id have no labels: their digests spread them over the join's tasks
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    known = (
        labels.where("doc_id is not null").groupBy("doc_id")
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        .withColumn("spread", F.lit(0).cast("long"))
    )
    marked = rows.join(known, ["doc_id", "spread"], "left").select(
        "digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"), "doc_id",
    )
    text = ["digest", "part", "mask", "good", "toxic"]
    per_id = marked.groupBy(*text, "doc_id").agg(F.count(F.lit(1)).alias("c"))
    per_text = per_id.groupBy(*text).agg(
        F.sum("c").alias("n"),
        F.min("doc_id").alias("least"),
        F.coalesce(F.min_by("c", "doc_id"), F.lit(0)).alias("n_least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("c"))), F.lit(0)).alias("n_null"),
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    split = per_text.withColumn("first", F.col("n_null") + F.when(first, F.col("n_least")).otherwise(0))
    sides = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")),
        F.struct((F.col("mask") + _E).alias("mask"), (F.col("n") - F.col("first")).alias("n")),
    )).alias("s")
    return (
        split.select("part", "good", "toxic", sides)
        .groupBy("part", F.col("s.mask").alias("mask"))
        .agg(
            F.sum("s.n").cast("long").alias("n"),
            F.sum(F.when(F.col("good"), F.col("s.n")).otherwise(0)).cast("long").alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("s.n")).otherwise(0)).cast("long").alias("toxic"),
        )
    )


def gray_walk(masks: np.ndarray, counts: np.ndarray, filters: int = len(FILTERS)) -> np.ndarray:
    """Survivors of every subset of filters: row s has the sums of ``counts`` over cells that fail none of s."""
    failing = np.zeros(len(masks), dtype=np.int64)
    now = counts.sum(axis=0)
    stored = np.empty((1 << filters, counts.shape[1]), dtype=np.int64)
    stored[0] = now
    subset = 0
    for i in range(1, 1 << filters):
        toggled = (i & -i).bit_length() - 1  # the bit by which Gray codes i - 1 and i differ
        hit = (masks >> toggled) & 1 == 1
        subset ^= 1 << toggled
        if subset >> toggled & 1:
            now = now - counts[hit & (failing == 0)].sum(axis=0)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            now = now + counts[hit & (failing == 0)].sum(axis=0)
        stored[subset] = now
    return stored


def order_report(part: str, survivors: np.ndarray) -> pd.DataFrame:
    """The rows of ``REPORT`` of one part: every order and step, as differences of stored survivors."""
    k = len(FILTERS)
    n, everything = survivors[:, 0], (1 << k) - 1
    fails = [int(n[0] - n[1 << f]) for f in range(k)]
    only = [int(n[everything ^ 1 << f] - n[everything]) for f in range(k)]
    share = [
        sum(
            math.factorial(t.bit_count()) * math.factorial(k - 1 - t.bit_count()) * int(n[t] - n[t | 1 << f])
            for t in range(1 << k) if not t >> f & 1
        )
        for f in range(k)
    ]
    rows = []
    for order in itertools.permutations(range(k)):
        name, done = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            after = done | 1 << f
            gone = survivors[done] - survivors[after]
            rows.append((part, name, step, n[after], gone[0], fails[f] - gone[0], only[f], gone[1], gone[2], share[f]))
            done = after
    return pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])


def _report_of(cells: pd.DataFrame) -> pd.DataFrame:
    counts = cells[["n", "good", "toxic"]].to_numpy(np.int64)
    return order_report(cells["part"].iloc[0], gray_walk(cells["mask"].to_numpy(np.int64), counts))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step (``REPORT``); a group is the at most 32 cells of a part."""
    return mask_cells(docs, labels).groupBy("part").applyInPandas(_report_of, REPORT)


SQL = r"""WITH base AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
masks AS (
  SELECT b.doc_id, part,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN min(b.doc_id) OVER (PARTITION BY body) < b.doc_id THEN 16 ELSE 0 END AS mask,
    coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM base b LEFT JOIN (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id) l ON b.doc_id = l.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
bits AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS fs, [a.b, b.b, c.b, d.b, e.b] AS bs
  FROM bits a, bits b, bits c, bits d, bits e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT array_to_string(fs, '') AS filter_order, CAST(i AS INTEGER) AS step, bs[i] AS bit,
         CAST(list_sum(bs[1:i]) AS BIGINT) AS after, CAST(coalesce(list_sum(bs[1:i-1]), 0) AS BIGINT) AS before
  FROM orders, range(1, 6) r(i)),
counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & after = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted"""
