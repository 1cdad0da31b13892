"""Rows without id and rows of one id: samples stay bounded, the mix is the same for any partitioning."""

from collections import Counter

from pyspark.sql import functions as F

from helpers import DOCS
from lotwise.llm import langid, mixing


def test_mix_of_rows_without_id_agrees(spark):
    rows = [(None, f"w{i} " * (3 + i % 2), "en", "a", i % 3) for i in range(200)] + [(7, f"x{i} y z", "fr", None, 0) for i in range(60)]
    rows += [(None, "same row", "en", "a", 1)] * 40
    df = spark.createDataFrame(rows, DOCS)
    drawn = [Counter(tuple(r) for r in mixing.mix(df.repartition(n)).collect()) for n in (1, 3, 7)]
    assert drawn[0] == drawn[1] == drawn[2] and sum(drawn[0].values()) > 200
    taken = [Counter(tuple(r) for r in mixing.report(df.repartition(n)).collect()) for n in (1, 5)]
    assert taken[0] == taken[1]


def test_chunks_follow_the_rows(spark):
    assert mixing.chunk_digits(0) == mixing.chunk_digits(10**7) == 2
    assert mixing.chunk_digits(10**12) > mixing.chunk_digits(10**9) > 2


def test_finer_chunks_draw_the_same_rows(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = Counter(tuple(r) for r in mixing.report(docs).collect())
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 0.1)
    assert mixing.chunk_digits(1000) == 4
    assert Counter(tuple(r) for r in mixing.report(docs).collect()) == plain


def test_language_sample_bounds_rows(spark, monkeypatch):
    """3,000 rows of one id give no more than the bound, and equal rows are one."""
    seen = []
    monkeypatch.setattr(langid, "Hierarchy", lambda x, langs: seen.append(Counter(langs)))
    rows = [(1, f"some words {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", "en", "s", 0) for i in range(3000)]
    rows += [(2, "toujours la même ligne", "fr", "s", 0)] * 500 + [(i, f"texte {chr(97 + i)}", "fr", "s", 0) for i in range(3, 20)]
    docs = spark.createDataFrame(rows, DOCS)
    for n in (1, 6):
        langid.fit(docs.repartition(n), per_lang=30)
    assert seen == [Counter(en=30, fr=18)] * 2


def test_language_of_no_rows(spark):
    assert langid.fit(spark.createDataFrame([], DOCS)) is None
    assert langid.fit(spark.createDataFrame([(1, None, "en", "s", 0), (2, "words", None, "s", 0)], DOCS).where(F.col("doc_id") > 0)) is None
