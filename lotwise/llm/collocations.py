"""Operator 11: phrase collocations by Toivonen's sampling method.

A sample of the documents proposes words and two-word phrases as frequent. A full pass then counts exactly
what they imply: all words, and every phrase whose shorter parts are all proposed, be it proposed itself
or on the negative border. If something on the border (or a word that was not proposed) turns out
frequent, the proposals failed there: they are widened by it and a further pass counts the
phrases that become possible, and only these, until a pass adds nothing. Then every frequent phrase has been
counted over all documents, whatever the sample was.

Proposals travel as two Bloom filters of fixed size (words, two-word phrases; ``FILTER_BITS`` bits each), so
what is broadcast does not grow. A false positive only has one phrase more counted; when the proposals outgrow the
filters, more is counted, never less. Widening sets bits, so a phrase that passes once passes ever after: a
pass counts what passes now and did not before, hence each phrase in exactly one pass, and the search
is closed when no bit is new.

A pass is one narrow stage that cuts texts on byte arrays and counts within slices of ``SLICE_BYTES``, and one
sum by (lang, phrase). Frequent phrases are staged; scores are joins and sums on them. Hot words and phrases
are one row per slice before the shuffle.

Null texts are empty, a null lang is ``und`` (with a lang of that name, if there is one). Repeated rows count again. Empty
tables and texts without phrases give no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import bloom
from lotwise.llm.common import staged
from lotwise.llm.word_cuts import byte_set, cut, mixed, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUPPORT = 10
TOP = 2000
#: A sample document in so many, and the count that proposes a phrase there (half the expected count of a
#: phrase at the support, two at least).
SAMPLE = 8
PROPOSED = max(2, SUPPORT // SAMPLE // 2)
FILTER_BITS = 1 << 25
SLICE_BYTES = 3 << 20

GAP, FENCE = byte_set(b" \t"), byte_set(b".,;:!?\n\x0b\x0c\r")
_LEVELS = (1, 2)
_COUNTS = "lang string, phrase string, c long"
_ROWS = 1 << 17


def lang_seed(lang: str) -> np.uint64:
    return word_hashes(pa.array([lang.encode()], pa.binary()))[0]


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(3) + mixed(b))


def _let_through(bits: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """All hashes if there is no filter."""
    return np.ones(len(h), dtype=bool) if bits is None else bloom.passes(bits, h)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def count_slice(texts: list[bytes], lang: str, now, before, longest: int):
    """(phrases, counts) of one slice: what the filters ``now`` let through and ``before`` did not.

    ``now`` and ``before`` are (words, pairs) filters; ``before`` is None in the first pass, which
    also counts all words. The empty phrase has the number of words.
    """
    c = cut(texts, GAP, FENCE)
    n, size = len(c.ids), max(1, len(c.words))
    if not n:
        return
    if before is None:
        yield pa.array([b""]), np.array([n])
        yield c.words, np.bincount(c.ids, minlength=len(c.words))
    seeded = word_hashes(c.words) + lang_seed(lang)
    at = np.flatnonzero(c.piece[1:] == c.piece[:-1])  # where a pair begins

    def allowed(filters):
        """Pairs whose words pass, and triples (by where they begin) whose pairs pass, as masks over ``at``."""
        word = _let_through(filters[0], seeded)
        pair = word[c.ids[at]] & word[c.ids[at + 1]]
        if longest < 3:
            return pair, None
        inner = np.zeros(n + 1, dtype=bool)
        live = at[pair]
        inner[live] = _let_through(filters[1], pair_hashes(seeded[c.ids[live]], seeded[c.ids[live + 1]]))
        return pair, inner[at] & inner[at + 1]

    pair, triple = allowed(now)
    if before is not None:
        old_pair, old_triple = allowed(before)
        pair &= ~old_pair
        triple &= ~old_triple
    i = at[pair]
    key, counts = _counted(c.ids[i] * size + c.ids[i + 1])
    yield pc.binary_join_element_wise(c.words.take(pa.array(key // size)), c.words.take(pa.array(key % size)), b" "), counts
    if longest < 3:
        return
    i = at[triple]
    first, back = np.unique(c.ids[i] * size + c.ids[i + 1], return_inverse=True)
    key, counts = _counted(back * size + c.ids[i + 2])
    first = first[key // size]
    parts = [c.words.take(pa.array(x)) for x in (first // size, first % size, key % size)]
    yield pc.binary_join_element_wise(*parts, b" "), counts


def _count(docs: DataFrame, sent, longest: int = 3) -> DataFrame:
    """(lang, k, phrase, c): exact counts over ``docs`` (lang, text) of the phrases to count, one row each.

    ``sent`` is a broadcast of the packed filters (now, before), None for those there are not.
    """

    def run(batches):
        now, before = [pair and tuple(map(bloom.unpacked, pair)) for pair in sent.value]
        now = now or (None, None)

        def flush(held):
            for lang, texts in held.items():
                for phrases, counts in count_slice(texts, lang, now, before, longest):
                    phrases = phrases.cast(pa.string())
                    for at in range(0, len(counts), _ROWS):
                        some = phrases.slice(at, _ROWS)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(some), pa.string()), some, pa.array(counts[at : at + _ROWS].astype(np.int64))],
                            names=["lang", "phrase", "c"])

        held, size = defaultdict(list), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held[lang].append(text)
                size += len(text)
                if size >= SLICE_BYTES:
                    yield from flush(held)
                    held, size = defaultdict(list), 0
        yield from flush(held)

    sums = docs.mapInArrow(run, _COUNTS).groupBy("lang", "phrase").agg(F.sum("c").alias("c"))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
    return sums.select("lang", words.alias("k"), "phrase", "c")


def filter_bits(phrases: DataFrame, k: int) -> np.ndarray:
    """The filter of the phrases (lang, k, phrase) of ``k`` words: at most FILTER_BITS / 64 rows reach the driver."""

    def run(batches):
        for batch in batches:
            langs = pc.dictionary_encode(batch.column(0))
            seeds = np.array([lang_seed(x) for x in langs.dictionary.to_pylist()], dtype=np.uint64)
            seed = seeds[langs.indices.to_numpy(zero_copy_only=False)] if batch.num_rows else np.zeros(0, np.uint64)
            words = pc.split_pattern(batch.column(1).cast(pa.string()), " ")
            flat = word_hashes(words.flatten().cast(pa.binary())).reshape(-1, k) + seed[:, None]
            h = flat[:, 0] if k == 1 else pair_hashes(flat[:, 0], flat[:, 1])
            made = bloom.slot_rows(h, FILTER_BITS)
            if made is not None:
                yield made

    return bloom.gathered(phrases.where(F.col("k") == k).select("lang", "phrase").mapInArrow(run, bloom.SLOTS), FILTER_BITS)


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, sample: int = SAMPLE, proposed: int = PROPOSED) -> DataFrame:
    """(lang, k, phrase, c) of all phrases of 1 to 3 words found ``support`` times or more; k = 0 has the number of words."""
    rows = docs.select(
        F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    some = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(sample)) == 0)
    send = docs.sparkSession.sparkContext.broadcast
    seen = staged(_count(some, send((None, None)), longest=2).where((F.col("c") >= proposed) & (F.col("k") > 0)), "proposals")
    before, now = None, tuple(filter_bits(seen, k) for k in _LEVELS)
    found = []
    while True:
        sent = send((tuple(map(bloom.packed, now)), before and tuple(map(bloom.packed, before))))
        counts = _count(rows, sent).where((F.col("k") == 0) | (F.col("c") >= support))
        found.append(staged(counts, "frequent"))
        sent.destroy()  # the pass is on disk
        wider = tuple(old | filter_bits(found[-1], k) for old, k in zip(now, _LEVELS))
        if all((a == b).all() for a, b in zip(now, wider)):
            return reduce(DataFrame.unionByName, found)
        before, now = now, wider


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, **kw) -> DataFrame:
    """The first ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n, score (all numbers long)."""
    every = frequent_phrases(docs, support, **kw)
    totals = every.where("k = 0").select("lang", F.col("c").alias("n"))
    counts = every.where("k > 0")
    words = F.split("phrase", " ")

    def joined(first, last):
        return F.array_join(F.slice(words, first, last - first + 1), " ")

    def split_at(k, last):
        return F.struct(F.lit(k).alias("cut"), joined(1, k).alias("left"), joined(k + 1, last).alias("right"))

    candidates = counts.where("k > 1").select("lang", "k", "phrase", F.col("c").alias("a"))
    cuts = candidates.select(
        "lang", "phrase", "a",
        F.explode(F.when(F.col("k") == 2, F.array(split_at(1, 2))).otherwise(F.array(split_at(1, 3), split_at(2, 3)))).alias("s"),
    ).select("lang", "phrase", "a", "s.*")
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("c").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("c").alias("r"))
    score = F.expr("(cast(1000000 as decimal(38,0)) * a * a) div (cast(l as decimal(38,0)) * r)").alias("score")
    weakest = (
        cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
        .select("lang", "phrase", "a", score, "cut", "l", "r")
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    )
    longer = (
        candidates.where("k = 3")
        .select("lang", F.explode(F.array(joined(1, 2), joined(2, 3))).alias("phrase"), F.col("a").alias("around"))
        .groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    )
    kept = weakest.join(longer, ["lang", "phrase"], "left").where("around is null or 100 * around < 50 * a")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "s.*").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = rf"""WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
pieces AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM docs),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM cut
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM cut
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM cut),
f AS (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= {SUPPORT}),
cuts AS (
  SELECT lang, phrase, a, 1 AS cut, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM cand
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM cand WHERE k = 3),
scored AS (
  SELECT u.lang, u.phrase, u.a, u.cut, x.c AS l, y.c AS r,
    CAST((1000000::HUGEINT * u.a * u.a) // (x.c::HUGEINT * y.c) AS BIGINT) AS score
  FROM cuts u JOIN f x ON u.lang = x.lang AND u.lp = x.phrase JOIN f y ON u.lang = y.lang AND u.rp = y.phrase),
weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, p, max(a) AS around FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS p FROM cand WHERE k = 3) GROUP BY lang, p),
kept AS (
  SELECT s.* FROM weakest s LEFT JOIN longer g ON s.lang = g.lang AND s.phrase = g.p
  WHERE g.around IS NULL OR 100 * g.around < 50 * s.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n.n AS n, score
FROM kept k JOIN n ON k.lang = n.lang QUALIFY rank <= {TOP}"""
