"""The one merge of each piece, and words at the limit between the fold and the heap."""

import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from helpers import DOCS
from lotwise.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


def greedy(word, last=None):
    """Ranked merges as defined; ``last`` collects every pair that is ever joined."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
        if not found:
            return parts
        _, i = min(found)
        if last is not None:
            last.add((parts[i], parts[i + 1]))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_every_join_is_the_last_merge_of_its_piece():
    rng = random.Random(1)
    pieces = [p for p in RANKS if len(p) > 1]
    joined = set()
    for _ in range(6000):
        word = b"".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))[: rng.randint(2, 30)]
        greedy(word, joined)
    assert len(joined) > 2000
    assert all(bpe.last_pair(a + b, RANKS) == (a, b) for a, b in joined)


def test_unreachable_pieces_have_no_pair():
    ranks = {bytes([b]): b for b in range(256)} | {b"abcd": 256}
    assert bpe.last_pair(b"abcd", ranks) is None
    assert bpe.last_pair(b"ab", ranks | {b"ab": 257}) == (b"a", b"b")


@pytest.mark.parametrize("chunk,long", [(1 << 20, 1024), (200, 6)])
def test_fold_and_heap_agree(spark, monkeypatch, chunk, long):
    """Words beyond ``LONG`` go to the heap, others through the fold; chunks of a few texts."""
    monkeypatch.setattr(bpe, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(bpe, "LONG", long)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab cde élß 12.\n") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    texts += ["z" * 1023, "z" * 1024, "y" * 1100, "", None, "  ", texts[0]]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(4)
    for r in bpe.encode(df.withColumn("chunk", F.lit(1)), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        import regex

        words = [w.encode() for w in regex.findall(P.PATTERN, texts[r.doc_id] or "")]
        assert list(r.ids) == [RANKS[p] for w in words for p in greedy(w)], texts[r.doc_id]


def test_many_long_texts_in_one_task(spark):
    text = " ".join(f"word{i % 977}x{i % 1009}" for i in range(30_000))
    df = spark.createDataFrame([(i, text[i:], "en", "s", 0) for i in range(40)], DOCS).coalesce(1)
    got = bpe.round_trip(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = df.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("d"))
    assert got.join(want, "doc_id").where("decoded_sha256 = d").count() == 40
