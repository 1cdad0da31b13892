"""From signatures to verified near-duplicate links, for sets of 64-bit shingle hashes.

1. *Banding.* A signature of ``m`` 16-bit values is cut into bands; items that agree on a band share a bucket.
   A bucket of two gives one candidate pair, kept if the signatures agree often enough; a larger one
   links all its members to its smallest (a star, never all pairs).
2. *Candidate groups* are the connected components of those links: every pair that shares a bucket is
   in one group, or was ruled out by its signatures.
3. *Verification* compares the full sets inside each group. Many small groups share a task; a large
   group is cut into blocks of bounded size. Its blocks are first linked inside and with a few pivots;
   members outside the group's largest class are then compared, block by block, with everything
   that they are not yet linked to. Pairs already in one class are skipped, so a group of copies costs
   about one comparison a member, and no link between classes is lost.

The caller joins the links with ``components.connected_components``. Tasks hold two blocks at
most; the driver sees a few totals.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.bloom import among, filter_of, passes, unpacked
from lotwise.llm.common import cut_lineage, shuffle_partitions, staged
from lotwise.llm.components import connected_components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 4096
PIVOTS = 8


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(rows: int, bands: int) -> list:
    return [F.xxhash64(F.lit(i), F.substring("sig", 2 * rows * i + 1, 2 * rows)) for i in range(bands)]


def banded(reps: DataFrame, rows: int, bands: int) -> DataFrame:
    """(key, id) for every band of ``reps (id, sig)``."""
    return reps.select("id", F.explode(F.array(*_keys(rows, bands))).alias("key"))


def banded_among(reps: DataFrame, rows: int, bands: int, keys: DataFrame) -> DataFrame:
    """The rows of ``banded`` whose key is one of ``keys``, and a few others: the rest is not shuffled to be joined."""
    pack = filter_of(keys)

    def run(batches):
        bits = unpacked(pack)
        for batch in batches:
            ids, found = batch.column(0).to_numpy(), []
            for column in batch.columns[1:]:
                h = column.to_numpy()
                at = np.flatnonzero(passes(bits, h.view(np.uint64)))
                found.append((ids[at], h[at]))
            both = [pa.array(np.concatenate(x)) for x in zip(*found)]
            yield pa.RecordBatch.from_arrays(both, names=["id", "key"])

    named = [k.alias(f"key{i}") for i, k in enumerate(_keys(rows, bands))]
    return reps.select("id", *named).mapInArrow(run, "id long, key long")


def agreement(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Share of equal values of two signature columns."""
    if not len(a):
        return np.zeros(0)
    x = np.frombuffer(b"".join(a), dtype=np.uint16).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), dtype=np.uint16).reshape(len(b), -1)
    return (x == y).mean(1)


def candidate_groups(reps: DataFrame, rows: int, bands: int, least: float) -> DataFrame:
    """(id, cand): the candidate group of every item of ``reps (id, sig)`` that is in one."""

    @F.pandas_udf("double")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(agreement(a, b))

    b = banded(reps, rows, bands)
    buckets = b.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"))
    buckets = staged(buckets.where("lo <> hi"), "buckets")
    pairs = staged(buckets.where("n = 2").select("lo", "hi").distinct(), "bucket_pairs")
    paired = reps.where(among(pairs.select(F.explode(F.array("lo", "hi"))))("id"))
    left = paired.select(F.col("id").alias("lo"), F.col("sig").alias("sig_lo"))
    right = paired.select(F.col("id").alias("hi"), F.col("sig").alias("sig_hi"))
    pairs = pairs.join(left, "lo").join(right, "hi").where(agree("sig_lo", "sig_hi") >= least)
    crowded = buckets.where("n > 2").select("key", "lo")
    stars = crowded.join(banded_among(reps, rows, bands, crowded.select("key")), "key").where("id <> lo")
    stars = stars.select("lo", F.col("id").alias("hi"))
    links = pairs.select("lo", "hi").unionByName(stars).select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    groups = connected_components(links)
    return groups.select(F.col("node").alias("id"), F.col("component").alias("cand"))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two arrays of distinct values have in common."""
    x = np.concatenate((a, b))
    x.sort()
    return int(np.count_nonzero(x[1:] == x[:-1]))


def link_rows(pdf: pd.DataFrame, sets_of, num: int, den: int, least: float, at_once=None) -> list[tuple[int, int]]:
    """Links (100-percent verified on full sets) that join different classes among the rows of a group."""
    pdf = pdf.drop_duplicates(["cand", "id"]).sort_values("cand", kind="stable")
    if len(pdf) < 2:
        return []
    group, every_id, every_label = (pdf[c].to_numpy() for c in ("cand", "id", "label"))
    every_sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint16).reshape(len(pdf), -1)
    every_text = pdf["payload"].tolist()
    every_set = at_once(every_text) if at_once else None
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    links = []
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - start < 2:
            continue
        ids, sig, texts = every_id[start:end], every_sig[start:end], every_text[start:end]
        label = every_label[start:end].copy()
        known: dict[int, np.ndarray] = {}

        def full(i):
            if every_set is not None:
                return every_set[start + i]
            if i not in known:
                known[i] = sets_of(texts[i])
            return known[i]

        for i in range(1, len(ids)):
            other = np.flatnonzero(label[:i] != label[i])
            if not len(other):
                continue
            est = np.count_nonzero(sig[other] == sig[i], axis=1) / sig.shape[1]
            other, est = other[est >= least], est[est >= least]
            for j in other[np.argsort(-est, kind="stable")].tolist():
                if label[j] == label[i]:
                    continue
                a, b = full(i), full(j)
                if den * min(len(a), len(b)) < num * max(len(a), len(b)):
                    continue
                both = shared(a, b)
                if den * both >= num * (len(a) + len(b) - both):
                    links.append((int(ids[i]), int(ids[j])))
                    label[label == label[j]] = label[i]
    return links


def verified_links(items: DataFrame, sets_of, num: int, den: int, least: float, at_once=None) -> DataFrame:
    """Links (u, v) between items of one candidate group whose sets have Jaccard >= num / den.

    ``items (id, cand, sig, payload)``; ``sets_of(payload)`` gives the sorted unique hashes, ``at_once`` (for short
    payloads) those of a list of them. Only links
    that join classes are returned, enough for the components to be exact.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(link_rows(pdf, sets_of, num, den, least, at_once), columns=["u", "v"], dtype="int64")

    def linked(keyed: DataFrame) -> DataFrame:
        cols = ["g1", "g2", "g3", "cand", "id", "label", "sig", "payload"]
        return keyed.select(*cols).groupBy("g1", "g2", "g3").applyInPandas(run, "u long, v long")

    items = staged(items, "compared_items")
    size = items.withColumn("bytes", F.octet_length("payload") + 100)
    groups = size.groupBy("cand").agg(F.sum("bytes").alias("total"), F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_BYTES), F.ceil(F.col("n") / BLOCK_ROWS)).cast("long")
    groups = cut_lineage(groups.withColumn("blocks", blocks).withColumn("every", F.greatest(F.lit(1), F.floor(F.col("n") / PIVOTS))))
    small, large = groups.agg(
        F.coalesce(F.sum(F.when(F.col("blocks") <= 1, F.col("total"))), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("blocks") > 1, 1)), F.lit(0)),
    ).first()
    spark = items.sparkSession
    bins = max(2 * shuffle_partitions(spark), math.ceil(small / BLOCK_BYTES))
    items = items.withColumn("label", F.col("id"))
    # groups of more than one block are few (one for every BLOCK_BYTES or BLOCK_ROWS of items at most)
    crowds = F.broadcast(groups.where("blocks > 1").select("cand", "blocks", "every"))
    packed = items.join(crowds, "cand", "left_anti") if large else items
    zero = F.lit(0).cast("long")
    packed = packed.withColumns({"g1": F.pmod(F.xxhash64("cand"), F.lit(bins)), "g2": zero - 1, "g3": zero})
    links = linked(packed)
    if not large:
        return links
    big = staged(items.join(crowds, "cand").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))), "large_groups")
    inside = big.withColumns({"g1": F.col("cand"), "g2": F.col("block"), "g3": zero})
    pivots = big.where(F.pmod(F.xxhash64("id", F.lit(1)), F.col("every")) == 0)
    pivots = pivots.withColumns({"g1": F.col("cand"), "g2": F.explode(F.sequence(zero, F.col("blocks") - 1)), "g3": zero})
    first = cut_lineage(linked(inside.unionByName(pivots.select(inside.columns))))
    classes = connected_components(first)
    big = big.drop("label").join(classes.withColumnRenamed("node", "id"), "id", "left")
    big = big.withColumn("label", F.coalesce("component", "id")).drop("component")
    sizes = big.groupBy("cand", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).alias("bytes"))
    main = sizes.groupBy("cand").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rest = sizes.join(main, "cand").where("label <> main").groupBy("cand").agg(
        F.greatest(F.ceil(F.sum("bytes") / BLOCK_BYTES), F.ceil(F.sum("n") / BLOCK_ROWS)).cast("long").alias("parts"))
    rest = cut_lineage(rest.join(main, "cand"))
    big = big.join(rest, "cand")
    part = F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts"))
    theirs = big.where("label <> main").withColumns(
        {"g1": F.col("cand"), "g2": part, "g3": F.explode(F.sequence(zero, F.col("blocks") - 1))})
    all_ = big.withColumns({"g1": F.col("cand"), "g2": F.explode(F.sequence(zero, F.col("parts") - 1)), "g3": F.col("block")})
    return links.unionByName(first).unionByName(linked(theirs.unionByName(all_.select(theirs.columns))))
