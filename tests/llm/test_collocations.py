"""Toivonen mining against counting everything by hand."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import DOCS
from lotwise.llm import collocations, word_cuts

LOWER = {i: i + 32 for i in range(65, 91)}


def by_hand(rows, support, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = []
        for p, a in counts.items():
            if len(p) < 2 or a < support:
                continue
            if len(p) == 2 and any(100 * c >= 50 * a for q, c in counts.items() if len(q) == 3 and c >= support and p in (q[:2], q[1:])):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def texts(seed=3, docs=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["É", "éa", "x\x1fy", "a-b"]
    out = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice([["New", "york", "city"], ["the", "the", "the"], [rng.choice(vocab)], [rng.choice(vocab), "of"]])
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", " ", ". ", "\n", "\x0b"]) for w in words)
        out.append((i, text, ["en", "fr", None, "und"][i % 4], "s", 0))
    return out + [(None, None, None, None, 0), (None, "", "en", None, 0), (1, " .,\n", "de", None, 0), (2, out[1][1], "fr", "s", 0)]


@pytest.mark.parametrize("sample,proposed", [(8, 2), (10**6, 2), (1, 1), (2, 40)])
def test_counts_do_not_depend_on_the_sample(spark, sample, proposed):
    """An empty sample proposes nothing: all phrases come from border failures, in several passes."""
    rows = texts()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = collocations.collocations(df, support=4, top=25, sample=sample, proposed=proposed).collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows, 4, 25)


def test_slices_and_partitions(spark, monkeypatch):
    rows = texts(5) + [(900, "big " * 20_000 + "tail of it", "en", "s", 0)]
    monkeypatch.setattr(collocations, "SLICE_BYTES", 500)
    for parts in (1, 7):
        df = spark.createDataFrame(rows, DOCS).repartition(parts)
        got = collocations.collocations(df, support=10).collect()
        assert sorted(tuple(r) for r in got) == by_hand(rows, 10, 2000)


def test_full_filters_only_count_more(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    rows = texts(6)
    got = collocations.collocations(spark.createDataFrame(rows, DOCS), support=5).collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows, 5, 2000)


def test_exact_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits."""
    a, l, r = 3_000_000_019, 4_000_000_007, 5_000_000_029
    got = spark.sql(f"SELECT {a}L a, {l}L l, {r}L r").select(
        F.expr("(cast(1000000 as decimal(38,0)) * a * a) div (cast(l as decimal(38,0)) * r)").alias("s")).first().s
    assert got == 1000000 * a * a // (l * r)


def test_empty_and_clashing_columns(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    rows = texts()
    df = spark.createDataFrame(rows, DOCS)
    for c in ("phrase", "k", "c", "a", "l", "r", "n", "rank", "cut", "around", "slot", "bits"):
        df = df.withColumn(c, F.lit("clash"))
    assert sorted(tuple(r) for r in collocations.collocations(df, support=4).collect()) == by_hand(rows, 4, 2000)


def test_cut_equals_regular_expressions():
    rng = random.Random(0)
    many = ["".join(rng.choice("aB é.,\t\n\x0b\x1fZ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    c = word_cuts.cut([t.encode() for t in many], collocations.GAP, collocations.FENCE)
    words = [w.decode() for w in c.words.to_pylist()]
    got = defaultdict(list)
    for d, p, i in zip(c.doc, c.piece, c.ids):
        got[d].append((p, words[i]))
    seen = set()
    for d, t in enumerate(many):
        pieces = [re.findall("[^ \t]+", x) for x in re.split("[.,;:!?\n\x0b\x0c\r]", t.translate(LOWER))]
        mine = defaultdict(list)
        for p, w in got[d]:
            mine[p].append(w)
        assert list(mine.values()) == [p for p in pieces if p]
        assert not seen & set(mine)
        seen |= set(mine)
    hashes = word_cuts.word_hashes(c.words)
    assert len(np.unique(hashes)) == len(words)
    again = word_cuts.cut([t.encode() for t in reversed(many)], collocations.GAP, collocations.FENCE)
    assert dict(zip(words, hashes)) == dict(zip([w.decode() for w in again.words.to_pylist()], word_cuts.word_hashes(again.words)))
