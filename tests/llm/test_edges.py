"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lotwise.llm import bpe, langid, licenses, lines, mixing, pq, quality, superminhash, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
EXTRA = ["size", "copies", "id", "sig", "score", "kept", "row", "h", "k", "chunk", "target", "dropped", "line", "d_id", "kept_id", "label", "n", "key", "v", "x", "s", "words", "ids"]
ROWS = [
    (1, "The same line here again.\nAnother line of words.", "en", "a", 1), (1, "The same line here again.\nAnother line of words.", "en", "a", 1),
    (2, "The same line here again.\nAnother line of words.", "en", None, 1), (None, None, None, None, None), (None, "null id, some words", "fr", "b", 2),
    (3, "", "de", "b", 0), (4, "   \n\t\n", None, "b", 3), (5, "word " * 30_000, "en", "a", 4), (6, "1234 5678 !!", "es", "c", 5), (7, "é" * 3000, "fr", "c", 6)]

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
RUNS = {
    "lines": lambda d, l: lines.line_report(d),
    "dedup_lines": lambda d, l: lines.dedup_lines(d),
    "near": lambda d, l: superminhash.group_documents(d),
    "keep_one": lambda d, l: superminhash.keep_one(d),
    "quality": lambda d, l: quality.assess(d, l),
    "keep_good": lambda d, l: quality.keep_good(d, l),
    "language": lambda d, l: langid.identify(d),
    "tokens": lambda d, l: token_counts.count_tokens(d, JSON),
    "mix_report": lambda d, l: mixing.report(d),
    "mix": lambda d, l: mixing.mix(d),
    "toxicity": lambda d, l: toxicity.assess(d, l),
    "bpe": lambda d, l: bpe.round_trip(d, RANKS, P.PATTERN),
    "licences": lambda d, l: licenses.scan_licenses(d),
}
PER_ROW = ["lines", "near", "quality", "language", "tokens", "mix_report", "toxicity", "bpe", "licences"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (None, 0, 1), (5, None, None), (6, 0, 1)], LABELS)


def _extra(df):
    for c in EXTRA:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows_and_clashing_columns(spark, labels, name):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    plain = RUNS[name](docs, labels)
    n = plain.count()
    if name in PER_ROW:
        assert n == len(ROWS)
    wide = RUNS[name](_extra(docs), _extra(labels))
    assert wide.count() == n
    if name not in PER_ROW:
        assert wide.columns == docs.columns + EXTRA and plain.columns == docs.columns


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_tables(spark, name):
    docs = spark.createDataFrame([], DOCS)
    assert RUNS[name](docs, spark.createDataFrame([], LABELS)).count() == 0


def test_defined_values(spark, labels):
    docs = spark.createDataFrame(ROWS, DOCS)
    lang = {(r.doc_id, r.lang_pred == "und") for r in langid.identify(docs).collect()}
    assert {(3, True), (4, True), (6, True)} <= lang
    near = [(r.doc_id, r.component_id, r.kept) for r in superminhash.group_documents(docs).collect()]
    assert near.count((1, 1, True)) == 2 and (2, 1, False) in near and (3, 3, True) in near and (None, None, True) in near
    dropped = sorted((r.doc_id, list(r.dropped)) for r in lines.line_report(docs).collect() if r.doc_id in (1, 2))
    assert dropped == [(1, []), (1, []), (2, [0, 1])]
    tokens = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, JSON).collect()}
    assert tokens[3] == 0 and tokens[5] > 30_000 - 2
    assert all(r.n_tokens == 0 for r in bpe.round_trip(docs.where("text is null"), RANKS, P.PATTERN).collect())


def test_vector_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pq.link_vectors(none).count() == 0
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "b"), (None, [0.0, 1.0], "c"), (4, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").withColumn("id", F.lit("clash"))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in pq.link_vectors(df).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (4, 0, 4, True), (None, 0, None, True)]
