"""Each operator against its brute-force definition, its library or held-out labels."""

import hashlib
import math
import os
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import helpers as H  # noqa: E402

from lotwise.llm import bpe, components, langid, licenses, lines, mixing, pq, quality, superminhash, token_counts, toxicity  # noqa: E402
from lotwise.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return H.prose()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, H.DOCS).repartition(5)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = Q.queries()[name](spark, SF)
    cols = got.columns
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({Q.oracle_sql()[name]})").fetchall()
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(90)], [(0, i) for i in range(1, 400)], [(5, 5), (None, 3)], [],
    [(hash((i, 1)) % 97 - 40, hash((i, 2)) % 97 - 40) for i in range(70)]])
def test_components(spark, edges, monkeypatch):
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    plain = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    want = H.components({x for e in plain for x in e}, plain)
    assert {r.node: r.component for r in components.connected_components(df).collect()} == want
    monkeypatch.setattr(components, "ONE_TASK", -1)
    assert {r.node: r.component for r in components.connected_components(df).collect()} == want


def test_line_dedup(docs, rows):
    want = H.dropped_lines(rows)
    got = {r.doc_id: list(r.dropped) for r in lines.line_report(docs).collect()}
    assert got == {d: want.get(d, []) for d, *_ in rows}
    kept = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    for d, t, *_ in rows:
        drop = want.get(d, [])
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)
        if drop and not H.WORD.search(left):
            assert d not in kept
        else:
            assert kept[d].text == left
            assert kept[d].n_chars == len(left or "")


def _near_documents(df, rows):
    sets = {d: H.shingle_set(t) for d, t, *_ in rows}
    want = H.components(sets, H.jaccard_links(sets, 85, 100))
    got = {r.doc_id: r for r in superminhash.group_documents(df).collect()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(s) for d, s in sets.items()}
    assert all(r.kept == (r.component_id == d) for d, r in got.items())


def test_near_documents(docs, rows):
    _near_documents(docs, rows)


def test_near_documents_in_blocks(docs, rows, monkeypatch):
    """The path of large groups: blocks, pivots and the comparison across classes."""
    from lotwise.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK_ROWS", 2)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    _near_documents(docs, rows)


def test_superminhash_is_unbiased_and_stops_early():
    rng = np.random.default_rng(2)
    gaps = []
    for _ in range(60):
        both, own = rng.integers(20, 300), rng.integers(1, 60)
        pool = rng.integers(0, 2**63, both + 2 * own, dtype=np.uint64)
        a, b = np.unique(pool[: both + own]), np.unique(np.r_[pool[:both], pool[both + own :]])
        sa, sb = superminhash.signature(a), superminhash.signature(b)
        gaps.append((sa == sb).mean() - both / (both + 2 * own))
        assert (sa >> np.uint64(32)).max() < superminhash.SLOTS
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.06


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    near = base[rng.integers(0, 30, 250)] + rng.normal(scale=0.12, size=(250, 16))
    x = np.vstack([base, near, base[:20], 3.0 * base[20:40]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (905, [float("inf")] + [1.0] * 15), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    g = u @ u.T
    np.fill_diagonal(g, -1)
    a, b = np.nonzero(g >= 0.9)
    links = list(zip(a.tolist(), b.tolist())) + [(906, 907), (907, 906)]
    n = Counter(i for i, _ in links)
    want = H.components([r[0] for r in rows], links)
    got = pq.link_vectors(df).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert found >= 0.9 * len(links)  # the index's recall; none below the threshold:
    assert all(r.n_links <= n[r.vec_id] for r in got)
    assert sum(want[r.vec_id] != r.component_id for r in got) <= 0.05 * len(got)
    assert all(r.n_links == 0 and r.kept for r in got if 900 <= r.vec_id <= 905)


def test_rule_statistics_by_definition():
    texts = ["", "a b c a b c", "A#b | <x> $5 & %\nsame line\nsame line\n \n ", "w " * 120, "é ü x " * 7 + "ende"]
    stats, _ = quality.statistics(texts)
    for t, row in zip(texts, stats.tolist()):
        words = H.WORD.findall(t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            if H.WORD.search(x):
                dup += x in seen
                seen.add(x)
        assert row == [len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)]


def test_quality_verdicts_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.assess(Q.table(spark, sf, "documents"), Q.table(spark, sf, "labels"))
    m = got.join(Q.table(spark, sf, "labels"), "doc_id").toPandas()
    ok = m[~m.base_failed]
    assert ok[ok.quality == 1].kept.mean() > 0.97
    assert ok[ok.quality == 0].kept.mean() < 0.1
    assert not m[m.base_failed].kept.any()


def test_isolation_forest_path_lengths():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(size=(500, 6)), [[30.0] * 6]])
    s = quality.Forest(rows).score(rows)
    assert s.argmax() == 500 and np.median(s[:-1]) < 0.55


def test_languages_held_out(spark):
    docs = Q.table(spark, "/root/testdata/sf0.01", "documents")
    m = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert m[m.held_out].shape[0] > 100
    assert (m[m.held_out].lang_pred == m[m.held_out].lang).mean() > 0.97
    assert m.score.between(0, 1).all()
    assert (m.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in m.doc_id]).all()


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own, library = token_counts.counter(path), Tokenizer.from_file(path)
    texts = [t or "" for _, t, *_ in H.prose()] + [
        "   ", " a", "a ", "a  b", "\n\n x\n", "a<|endoftext|>b  <|endoftext|>", "don't DON'T 'sx's", "x" * 4000, "ab" * 2000 + " " * 99,
        "日本語 123４５ ²³ ½ Ⅷ", "\x1c\x1d a\x85b \x0b\x0c", " \n \n", "a \n b", " 'll", "👍🏽 x"]
    assert own.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.count(texts) == own.count(texts)  # from memory


def test_whole_tokens_are_proved():
    own = token_counts.counter(P.path("byte_bpe_50k.json"))
    assert " the" in own.whole and len(own.whole) > 45_000
    some = sorted(own.whole)[::997]
    assert own.count(some) == [1] * len(some)


def test_byte_bpe_round_trip(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = [t for _, t, *_ in H.prose()] + ["a<|endoftext|>b", "日本語 é👍🏽 ¼ \n\n x", "ab" * 700, "don't", "\x00"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in bpe.round_trip(df, path, P.PATTERN).collect():
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_mix_reaches_targets(spark):
    docs = Q.table(spark, "/root/testdata/sf0.01", "documents")
    r = mixing.report(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert (r.taken <= 2 * r["size"]).all()
    total = r["size"].sum()
    by = r.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert math.isclose(by.target.sum(), 1.5 * total, rel_tol=1e-9)
    assert (by.target <= 2 * by["size"] + 1e-6).all()
    assert ((by.taken - by.target).abs() <= 0.12 * by.target).all()
    free = by[by.target < 2 * by["size"] - 1e-6]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(by.index, key=lambda s: s.encode()))}
    levels = [t / w[s] for s, t in free.target.items()]
    assert max(levels) - min(levels) < 1e-6 * max(levels)
    assert sum(c.taken for c in mixing.report(docs).collect()) == by.taken.sum()  # reruns agree
    assert mixing.mix(docs).count() == (r.taken / r["size"]).sum()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = Q.table(spark, sf, "documents"), Q.table(spark, sf, "labels")
    m = toxicity.assess(docs, labels).join(labels, "doc_id").toPandas()
    held = m[m.held_out]
    assert (held[held.toxic == 0].predicted == 0).mean() > 0.98
    assert (held[held.toxic == 1].predicted == 1).mean() > 0.8  # labels are noisy
    assert m.score.between(0, 1).all()


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vocab = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 30))) for _ in range(700)]
    counts = [toxicity.words_of(t) for t in texts]
    index = toxicity.Index(list(range(700)), counts, [int("waa" in t) for t in texts])
    dense = np.zeros((700, len(index.vocab)))
    for i, (t, w) in enumerate(index.vectors):
        dense[i, t] = w
    for words in counts[:60]:
        t, w = index.vector(words)
        q = np.zeros(len(index.vocab))
        q[t] = w
        rows, cosines = index.nearest(t, w, 20)
        want = np.sort(dense @ q)[::-1]
        want = want[want > 0][:20]
        assert np.allclose(np.sort(cosines)[::-1], want)


def test_licences(spark):
    mit = licenses.KNOWN[0][1]
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(" ", "  ")), (2, mit + " And more."), (3, "Prose.\nReleased under the MIT licence!\nEnd."),
        (4, "Licensed under CC-BY-NC 4.0"), (5, None), (6, ""), (3, "Prose.\nReleased under the MIT licence!\nEnd.")]
    got = sorted((r.doc_id, r.license_id, r.license_ids, r.n_license_lines) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id != 3)
    assert got == [(1, "MIT", "MIT", 0), (2, None, "", 0), (4, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1), (5, None, "", 0), (6, None, "", 0)]
