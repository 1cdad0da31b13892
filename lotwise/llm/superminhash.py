"""Operator 5: near-duplicate documents by SuperMinHash.

A document's set is its distinct 5-word shingles (64-bit hashes; words lower-cased in A-Z). Every
element walks through the signature slots in an order of its own (a Fisher-Yates permutation drawn
from its hash) and offers each the value step + random fraction; a slot keeps the smallest offer. The
offers of an element are correlated, which lowers the variance, and later steps cannot beat slots
already below them, so the walk stops early: for long texts after the first step.

Documents with equal sets are one class from the start (by set digest). Classes are banded, verified
on full sets and joined into components (``neardup``, ``components``); a component keeps its
smallest doc_id.

Null texts and texts without words have the empty set: they link with nothing and are kept. A row
without doc_id takes part, but only a component of such rows alone has a null component_id. Rows that
repeat a doc_id with an equal text get equal results. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.bloom import among
from lotwise.llm.common import map_text, staged
from lotwise.llm.components import connected_components
from lotwise.llm.neardup import candidate_groups, mix64, verified_links

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 5
#: Jaccard threshold as a fraction.
NUM, DEN = 85, 100
#: Bands times rows of the signature: a pair at the threshold is missed with probability 8e-5.
BANDS, ROWS = 20, 6
SLOTS = BANDS * ROWS
#: Signatures that agree less often than this belong to no linked pair (6 standard deviations).
LEAST = 0.65

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def word_hashes(text: str, known: dict) -> np.ndarray:
    """64-bit hashes of the words of a text; ``known`` remembers them."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    out = []
    for w in text.encode("utf-8").lower().split():  # bytes: A-Z and ASCII white space only
        h = known.get(w)
        if h is None:
            h = known[w] = digest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingles(text: str | None, known: dict | None = None) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    words = word_hashes(text, {} if known is None else known)
    n = len(words)
    if n == 0:
        return words
    with np.errstate(over="ignore"):
        if n < WIDTH:
            return mix64((words * _FACTORS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        total = words[: n - WIDTH + 1] * _FACTORS[0]
        for k in range(1, WIDTH):
            total += words[k : n - WIDTH + 1 + k] * _FACTORS[k]
        return np.unique(mix64(total))


def signature(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signature: per slot the smallest (step << 32 | fraction) offered."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(slots, empty)
    order, rows = None, np.arange(len(elements))
    for step in range(slots):
        if sig.max() < np.uint64(step << 32):
            break  # every slot is below anything that this step could offer
        with np.errstate(over="ignore"):
            drawn = mix64(elements + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15))
        fraction = drawn & np.uint64(0xFFFFFFFF)
        pick = step + (((drawn >> np.uint64(32)) * np.uint64(slots - step)) >> np.uint64(32)).astype(np.int64)
        if step == 0:
            slot = pick
        else:
            if step == 1:  # the first swap is applied only when a second step is needed
                order = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
                order[rows, first] = 0
                order[:, 0] = first
            slot = order[rows, pick]
            order[rows, pick] = order[:, step]
            order[:, step] = slot
        if step == 0:
            first = pick
        np.minimum.at(sig, slot, fraction | np.uint64(step << 32))
    return sig


def fingerprint(sig: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return (mix64(sig) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, id (set digest, null if empty), sig: one row per document."""

    def worker():
        import xxhash

        known: dict = {}

        def work(texts):
            rows = []
            for text in texts:
                if len(known) > 500_000:
                    known.clear()
                s = shingles(text, known)
                if len(s):
                    digest = xxhash.xxh3_64_intdigest(s.tobytes())
                    rows.append((len(s), digest - (1 << 64) if digest >> 63 else digest, fingerprint(signature(s))))
                else:
                    rows.append((0, None, None))
            return zip(*rows)

        return work

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return map_text(keyed, "text", "n_shingles long, id long, sig binary", worker)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketch of every document, and for every set of shingles its class_id and best (doc_id and text_key
    of the document that its component keeps)."""
    sketched = staged(sketches(docs), "sketches")
    reps = staged(
        sketched.where("id is not null").groupBy("id").agg(
            F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("doc_id").alias("first_doc"), F.first("sig").alias("sig")),
        "set_classes")
    groups = staged(candidate_groups(reps, ROWS, BANDS, LEAST), "candidate_groups")
    wanted = staged(groups.join(reps.where(among(groups.select("id"))("id")), "id").select(
        "id", "cand", "sig", F.col("rep.doc_id").alias("rep_doc"), F.col("rep.text_key").alias("rep_key")), "compared_sets")
    texts = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    texts = texts.where(among(wanted.select("rep_key"))("text_key"))
    items = wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("rep_doc")) & (F.col("text_key") == F.col("rep_key"))).select(
        "id", "cand", "sig", F.col("text").alias("payload")).dropDuplicates(["id"])  # rows may be repeated
    classes = connected_components(verified_links(items, shingles, NUM, DEN, LEAST))
    classes = classes.withColumnRenamed("node", "id").join(reps.select("id", "first_doc", "rep"), "id")
    lowest = classes.groupBy("component").agg(F.min("first_doc").alias("lowest"), F.min("rep").alias("best"))
    classes = classes.join(lowest, "component").select("id", "lowest", "best")
    return sketched, reps.select("id", "first_doc", "rep").join(classes, "id", "left").select(
        F.col("id").alias("class_id"), F.coalesce("lowest", "first_doc").alias("component_id"), F.coalesce("best", "rep").alias("best"))


def group_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    sketched, component = _classes(docs)
    component = component.drop("best")
    none = sketched.where("id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    some = sketched.where("id is not null").join(component, F.col("id") == F.col("class_id")).select("doc_id", "n_shingles", "component_id")
    out = none.unionByName(some)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns: one row of each component, that of smallest doc_id (null first),
    then of smallest hash of the text; of equal rows any, of rows that differ in other columns the smallest.
    Documents without a word stay."""
    sketched, component = _classes(docs)
    best = component.select("best.doc_id", "best.text_key").distinct()
    none = sketched.where("id is null").select("doc_id", "text_key").distinct()
    stay = best.withColumn("one", F.lit(True)).unionByName(none.withColumn("one", F.lit(False)))
    often = sketched.where("id is not null").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = often.select(F.col("doc_id").alias("o_id"), F.col("text_key").alias("o_key"))
    stay = stay.join(often, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("text_key") == F.col("o_key")), "left")
    stay = stay.select(F.col("doc_id").alias("s_id"), F.col("text_key").alias("s_key"), (F.col("one") & F.col("o_key").isNotNull()).alias("cut"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("r_id"), F.xxhash64("text").alias("r_key"))

    def those(keys):
        return rows.join(keys, F.col("r_id").eqNullSafe(F.col("s_id")) & (F.col("r_key") == F.col("s_key")), "left_semi")

    stay = staged(stay, "staying")
    single = those(stay.where("not cut")).select("row")
    cut = those(stay.where("cut")).groupBy("r_id", "r_key").agg(F.min("row").alias("row")).select("row")
    return single.unionByName(cut).select("row.*")
