"""Pre-tokens of a chunk: those of each whole text, with few calls of the pattern (finding of round 3: CPU seconds of op9)."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex

from lotwise.llm import bpe


def cut(texts, pattern=P.PATTERN):
    """Pre-tokens of each text by a Cutter, and the number of times that it called the pattern."""
    cutter, calls = bpe.Cutter(pattern), []
    find = cutter.find
    cutter.find = lambda text: calls.append(1) or find(text)
    order, lens, numbers, words = cutter.cut(pa.array(texts, pa.string()))
    words = [w.decode("utf-8") for w in words.to_pylist()]
    assert len(set(words)) == len(words)
    rows = np.split(numbers, np.cumsum(lens))[:-1]
    found = {int(i): [words[k] for k in row] for i, row in zip(order, rows)}
    return [found[i] for i in range(len(texts))], len(calls)


@pytest.mark.parametrize("alphabet", ["ab cd' e1.\n", "a  \n\t'", "ab'é日 　\x1c.s12", "a' \ns", "x\xa0y \r\n"])
@pytest.mark.parametrize("units", [1 << 16, 2])
def test_same_as_the_pattern(monkeypatch, alphabet, units):
    monkeypatch.setattr(bpe, "_SLICE_UNITS", units)
    rng = random.Random(7)
    for _ in range(60):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 9))]
        texts += [None, "", texts[0]]
        for pattern in (P.PATTERN, "[a-z]+| "):  # the second leaves characters out
            assert cut(texts, pattern)[0] == [regex.findall(pattern, t or "") for t in texts]


@pytest.mark.parametrize("texts", [[""], [None], [" "], ["  "], ["\n"], ["a "], [" a\n", "a\n", "a", " a", "b \x00"]])
def test_edges(texts):
    assert cut(texts)[0] == [regex.findall(P.PATTERN, t or "") for t in texts]


def test_calls_do_not_grow_with_the_different_words():
    """Before, the pattern was called for each different word (10,000 here), and every word was looked up by Python."""
    texts = [" ".join(f"w{i % 100}x{k}." for i in range(k, k + 1000)) for k in range(100)]
    got, calls = cut(texts)
    assert got == [regex.findall(P.PATTERN, t) for t in texts]
    assert calls <= len(texts) + 10


@pytest.mark.parametrize("size", [1, 10, 35, 1000])
def test_chunks_hold_every_row_once(spark, monkeypatch, size):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", size)
    texts = ["ten chars!", None, "", "two  spaces", "x" * 100, "é", " "] * 3
    batches = [
        pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array(texts[a:b], pa.string())], names=["doc_id", "text"])
        for a, b in ((0, 4), (4, 4), (4, 5), (5, 21))]
    seen, chunks = {}, list(bpe._chunks(P.PATTERN, "bigint")(iter(batches)))
    for chunk in chunks:
        lens, tokens = bpe.unpack(chunk.column("tokens")[0].as_py())
        words = bpe.words_of(*bpe.unpack(chunk.column("words")[0].as_py())).to_pylist()
        ids = chunk.column("doc_ids")[0].as_py()
        assert len(ids) == len(lens) and not set(ids) & set(seen)
        seen |= {i: [words[k] for k in row] for i, row in zip(ids, np.split(tokens, np.cumsum(lens)))}
    assert seen == {i: [w.encode() for w in regex.findall(P.PATTERN, t or "")] for i, t in enumerate(texts)}
    assert len(chunks) == 1 if size == 1000 else len(chunks) > 1
