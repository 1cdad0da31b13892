"""Elias-Fano sequences, the trie, and the scores of the n-gram model against plain dictionaries."""

import math
import random
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import DOCS, WORD, prose
from lotwise.llm import elias_fano, lm_score
from lotwise.llm.elias_fano import EliasFano, Trie


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**45)), max_size=200))
def test_sequence_access_and_find(values):
    values = sorted(values)
    e = EliasFano.encode(np.array(values, dtype=np.int64))
    assert e.access(np.arange(len(values))).tolist() == values
    once = sorted(set(values))
    e = EliasFano.encode(np.array(once, dtype=np.int64))
    asked = once + [x + 1 for x in once] + [x - 1 for x in once] + [0, 2**46]
    at = {x: i for i, x in enumerate(once)}
    assert e.find(np.array(asked, dtype=np.int64)).tolist() == [at.get(x, -1) for x in asked]


def test_trie_lookup_from_a_mapped_file():
    rng = random.Random(2)
    counts = Counter((rng.randint(0, 30), rng.choice([1, 5, 9**9, rng.randint(0, 60)]), rng.randint(0, 40)) for _ in range(6000))
    keys = sorted(counts)
    u, v, w = np.array(keys, dtype=np.int64).T
    c = np.array([counts[k] for k in keys], dtype=np.int64)
    of_word, of_pair = Counter(), Counter()
    for k, n in counts.items():
        of_word[k[0]] += n
        of_pair[k[:2]] += n
    total = np.array([of_word[k[0]] for k in keys], dtype=np.int64)
    with tempfile.TemporaryFile() as f:
        Trie.build(u, v, w, c, total, 3.0, 2.0).save(f)
        trie = Trie.mapped(np.memmap(f, dtype=np.uint8, mode="r"))
        asked = sorted({(k[0] + rng.choice([0, 0, 7]), k[1] + rng.choice([0, 0, 1]), k[2] + rng.choice([0, 0, 5])) for k in keys})
        pairs = sorted({k[:2] for k in asked})
        size = np.array([sum(k[:2] == p for k in asked) for p in pairs])
        pu, pv = np.array(pairs, dtype=np.int64).T
        prob2, back2, prob3 = trie.lookup(pu, pv, size, np.array([k[2] for k in asked], dtype=np.int64))
    for p, a, b in zip(pairs, elias_fano.decode_probability(prob2), elias_fano.decode_probability(back2)):
        want = (of_pair[p] / (of_word[p[0]] + 3), 2 / (of_pair[p] + 2)) if p in of_pair else (0, 0)
        assert (a, b) == (pytest.approx(want[0], rel=3e-4), pytest.approx(want[1], rel=3e-4))
    for k, a in zip(asked, elias_fano.decode_probability(prob3)):
        assert a == pytest.approx(counts[k] / (of_pair[k[:2]] + 2) if k in counts else 0, rel=3e-4)
    bits = sum(a.nbytes for s in (trie.pairs, trie.triples) for a in s.arrays) * 8
    assert bits / (len(keys) + len(of_pair)) < 40  # ids reach 9**9


def tokens_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + ["</s>"]


def by_hand(rows, mu2, mu3):
    """doc rows -> (held_out, n_tokens, n_known, N, base, score), in order."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, *_ in rows]
    seqs = [["<s>", "<s>", *tokens_of(t)] for _, t, *_ in rows]
    one, two, three, context = Counter(), Counter(), Counter(), Counter()
    for h, s in zip(held, seqs):
        if not h:
            one.update(s[2:])
            context.update(s[1:-1])
            two.update(zip(s[1:], s[2:]))
            three.update(zip(s, s[1:], s[2:]))
    pair = Counter()
    for (a, b, _), c in three.items():
        pair[a, b] += c
    total, types = sum(one.values()), len(one)
    out = []
    for h, s in zip(held, seqs):
        base = score = known = 0
        for a, b, w in zip(s, s[1:], s[2:]):
            p1 = (one[w] + 0.5) / (total + 0.5 * (types + 1))
            p2 = (two[b, w] + mu2 * p1) / (context[b] + mu2)
            p3 = (three[a, b, w] + mu3 * p2) / (pair[a, b] + mu3)
            base += math.log10(p1)
            score += math.log10(p3)
            known += one[w] > 0
        out.append((h, len(s) - 2, known, total, base, score))
    return out


def same(got, rows):
    got = sorted(((r.doc_id, *list(r)[1:]) for r in got), key=str)
    want = sorted(((r[0], *x) for r, x in zip(rows, by_hand(rows, lm_score.MU2, lm_score.MU3))), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-3, abs=1e-3 + 2e-4 * w[2])


ROWS = prose(40) + [(None, "null id, some words", "en", None, 0), (None, None, None, None, 0), (3, "a repeated row", "en", "s", 0), (3, "a repeated row", "en", "s", 0), (5, "É\x1fa \x0b b\x0cB", "fr", "s", 0)]


@pytest.mark.parametrize("parts,chunk,shard", [(1, 1 << 20, 1 << 20), (5, 3000, 700)])
def test_scores_equal_the_smoothed_model(spark, monkeypatch, parts, chunk, shard):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", shard)
    got = lm_score.score_corpus(spark.createDataFrame(ROWS, DOCS).repartition(parts)).collect()
    same(got, ROWS)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(held, "only held out", "en", "s", 0)]
    got = lm_score.score_corpus(spark.createDataFrame(rows, DOCS)).collect()
    assert [tuple(r) for r in got] == [(held, True, 4, 0, 0, 0.0, 0.0)]
    assert lm_score.score_corpus(spark.createDataFrame([], DOCS)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    for c in ("chunk", "shard", "message", "held_out", "tokens", "words", "n_tokens", "score", "key"):
        df = df.withColumn(c, F.lit("clash"))
    same(lm_score.score_corpus(df).collect(), ROWS)


def test_better_than_words_alone_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_score.score_corpus(docs).where("held_out").groupBy().agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_model_levels_answer_alone(spark):
    """The stored levels of all shards hold every training triple once."""
    df = spark.createDataFrame(ROWS, DOCS)
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, *_ in ROWS]
    want = {x for h, (_, t, *_) in zip(held, ROWS) if not h for s in [["<s>", "<s>", *tokens_of(t), "pad"]] for x in zip(s, s[1:], s[2:])}
    levels = lm_score.model_levels(df).collect()
    assert sum(Trie.mapped(np.frombuffer(bytes(r.levels), dtype=np.uint8)).triples.n for r in levels) == len(want)
