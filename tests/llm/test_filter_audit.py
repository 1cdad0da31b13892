"""The audit of all filter orders against applying the filters one after another."""

import itertools
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import DOCS, WORD
from lotwise.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, LONG, "a"), (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "b"), (2, LONG + " x", None), (3, None, None), (4, "", ""),
    (None, LONG, "a"), (None, "few words", "b"), (None, "few words", "b"), (5, "few words", "b"), (6, "SHOUT " * 70, "a"),
    (7, "same # same " * 40, "a"), (8, LONG + " $", "c"), (9, "A B\x1fC \x0bd\x0ce", "c"), (10, "é" * 300 + "A" * 20, "c"),
    (11, LONG * 900, "a"), (12, LONG * 900, "c"), (-3, LONG + " x", "d"), (13, " \n\t", "d"),
]
MARKS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, 1, 1), (None, 1, 1), (7, None, None), (12, 1, 1), (99, 1, 1), (5, 0, 1)]


def by_hand(rows, marks):
    good = {d for d, q, _ in marks if d is not None and q == 1}
    toxic = {d for d, _, t in marks if d is not None and t == 1}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    parts = defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = set()
        fails |= {"A"} if len(w) < 50 else set()
        fails |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if d is not None and least[t] < d else set()
        parts[s or ""].append((fails, d in good, d in toxic))
    out = set()
    for part, docs in parts.items():
        steps, shapley = [], defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                failing = sum(f in x[0] for x in docs)
                steps.append((part, "".join(order), step, len(left), len(gone), failing - len(gone),
                              sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone), f))
        out |= {(*x[:9], shapley[x[9]]) for x in steps}
    return out


def test_equals_applying_the_filters(spark):
    docs = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in ROWS], DOCS)
    labels = spark.createDataFrame(MARKS, LABELS)
    for parts in (1, 5):
        got = [tuple(r) for r in filter_audit.audit(docs.repartition(parts), labels.repartition(parts)).collect()]
        assert len(got) == len(set(got)) == 600 * 5
        assert set(got) == by_hand(ROWS, MARKS)


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in ROWS], DOCS)
    labels = spark.createDataFrame(MARKS, LABELS)
    for c in ("part", "mask", "digest", "good", "toxic2", "n", "c", "first", "spread", "least", "kept"):
        docs, labels = docs.withColumn(c, F.lit("clash")), labels.withColumn(c, F.lit("clash"))
    assert filter_audit.audit(docs, labels).count() == 3000
    none = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(none, labels).count() == 0
    bare = filter_audit.audit(docs, spark.createDataFrame([], LABELS))
    assert bare.where("good_lost + toxic_lost > 0").count() == 0


def test_hot_repeated_row(spark):
    docs = spark.range(30_000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.lit("the same")).otherwise(F.lit(LONG)).alias("text"), F.lit("s").alias("source"))
    cells = {r["mask"]: r["n"] for r in filter_audit.mask_cells(docs, spark.createDataFrame([], LABELS)).collect()}
    # ids 1 and 2 are the first of their texts; every other row repeats one of them
    assert sum(cells.values()) == 30_000 and cells[0] == 1 and cells[1] == 1 and cells[16] == 14_999 and cells[17] == 14_999


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.tuples(st.integers(0, 9), st.integers(0, 5), st.integers(0, 5)), min_size=1))
def test_gray_walk_stores_all_subsets(cells):
    masks = np.array(list(cells), dtype=np.int64)
    counts = np.array(list(cells.values()), dtype=np.int64)
    stored = filter_audit.gray_walk(masks, counts)
    for subset in range(32):
        assert list(stored[subset]) == list(counts[masks & subset == 0].sum(axis=0))
