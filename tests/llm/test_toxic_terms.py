"""All words of the examples are evidence; the sample is bounded by rows; scores equal a plain computation."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from helpers import DOCS
from lotwise.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def _texts(seed=5, clean=300, toxic=90):
    rng = np.random.default_rng(seed)
    plain = [f"plain{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows = [(0, " ".join(rng.choice(plain, 12))) for _ in range(clean)]
    return rows + [(1, " ".join(rng.choice(plain, 12)) + (" vilest" if i < 3 else " horrid")) for i in range(toxic)], plain


def test_rare_toxic_words_are_evidence():
    texts, plain = _texts()
    examples = [(i, toxicity.words_of(t), y) for i, (y, t) in enumerate(texts)]
    model = toxicity.Model(examples, {0: 1.0, 1: 1.0})
    assert set(model.index.vocab) == {w for _, c, _ in examples for w in c}  # nothing is left out
    rows, cosines = model.index.nearest(*model.index.vector(toxicity.words_of("vilest words of mine")), 3)
    assert sorted(model.index.ids[rows]) == [300, 301, 302] and (cosines > 0).all()
    assert model.score(" ".join(plain[:5]))[1]  # plain words have neighbours too


def _plain_scores(rows, labels, k):
    """The definition: dense vectors, all cosines sorted, votes, pooled-adjacent-violators steps."""
    y_of = {d: t for d, _, t in labels if t in (0, 1) and zlib.crc32(str(d).encode()) % 3 != 1}
    examples = sorted({(d, t) for d, t in rows if d in y_of})
    words = [Counter(toxicity._TERM.findall((t or "").lower())) for _, t in examples]
    ys = [y_of[d] for d, _ in examples]
    n, df, dft = len(examples), Counter(), Counter()
    for c, y in zip(words, ys):
        df.update(c.keys())
        dft.update(c.keys() if y else ())
    weight = {}
    for t in df:
        a, b = dft[t], df[t] - dft[t]
        c, e = sum(ys) - a, n - sum(ys) - b
        below = (a + b) * (c + e) * (a + c) * (b + e)
        chi = n * (a * e - b * c) ** 2 / below if below else 0
        weight[t] = (math.log((1 + n) / (1 + df[t])) + 1) * min(1, max(toxicity.LEAST, math.sqrt(chi / toxicity.CHI2)))

    def vector(c):
        v = {t: (1 + math.log(x)) * weight.get(t, (math.log(1 + n) + 1) * toxicity.LEAST) for t, x in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items() if t in weight}

    vectors = [vector(c) for c in words]

    def vote(v, leave=None):
        sims = sorted(((-round(sum(x * u.get(t, 0) for t, x in v.items()), 12), examples[i][0], i) for i, u in enumerate(vectors) if i != leave))
        near = [(-s, i) for s, _, i in sims[:k] if s < 0]
        return sum(s * ys[i] for s, i in near) / k if near else None

    left = [(vote(v, i), ys[i]) for i, v in enumerate(vectors)]
    none = [y for x, y in left if x is None]
    by_vote = defaultdict(list)
    for x, y in left:
        if x is not None:
            by_vote[x].append(y)
    pools = []
    for x in sorted(by_vote):
        pools.append((x, by_vote[x]))
        while len(pools) > 1 and sum(pools[-2][1]) / len(pools[-2][1]) >= sum(pools[-1][1]) / len(pools[-1][1]):
            (_, second), (x0, first) = pools.pop(), pools.pop()
            pools.append((x0, first + second))
    out = []
    for _, t in rows:
        x = vote(vector(Counter(toxicity._TERM.findall((t or "").lower()))))
        if x is None:
            out.append(sum(none) / len(none) if none else 0.0)
        else:
            step = [p for p in pools if p[0] <= x + 1e-12] or pools[:1]
            out.append(sum(step[-1][1]) / len(step[-1][1]))
    return out


def test_scores_equal_the_definition(spark):
    texts, _ = _texts(seed=8, clean=120, toxic=40)
    rows = [(i, t) for i, (_, t) in enumerate(texts)] + [(500, ""), (501, None), (502, "unknown words only"), (503, "horrid horrid")]
    labels = [(i, 1, y) for i, (y, _) in enumerate(texts)] + [(None, 1, 1), (999, 0, 1), (500, 1, 0)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(4)
    got = {r.doc_id: r.score for r in toxicity.assess(docs, spark.createDataFrame(labels, LABELS)).collect()}
    want = _plain_scores(rows, labels, toxicity.NEIGHBOURS)
    for (i, _), w in zip(rows, want):
        assert abs(got[i] - w) < 1e-9, i


def test_a_repeated_id_does_not_fill_the_sample(spark):
    """3,000 rows of one id: rows are bounded, equal rows are one example, the rest of the sample is kept."""
    free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1][:6]
    rows = [(free[0], "same words again", "en", "s", 0)] * 1500 + [(free[0], f"word{'abcdefghij'[k % 10]} other{'abcdefghij'[k // 150]}", "en", "s", 0) for k in range(1500)]
    rows += [(i, "clean text here", "en", "s", 0) for i in free[1:]]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(free[0], 0, 1), *[(i, 1, 0) for i in free[1:]]], LABELS)
    for parts in (1, 6):
        model = toxicity.fit(docs.repartition(parts), labels, per_label=20)
        assert sorted(Counter(model.index.labels.tolist()).items()) == [(0, 5), (1, 20)]
        whole = toxicity.fit(docs.repartition(parts), labels, per_label=500)
        assert sorted(Counter(whole.index.labels.tolist()).items()) == [(0, 5), (1, 101)]


def test_blocks_are_skipped(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    model.index.scored = model.index.seen = 0
    for r in docs.where(F.col("doc_id") % 7 == 0).select("text").collect():
        model.score(r.text)
    assert model.index.seen and model.index.scored < 0.9 * model.index.seen
