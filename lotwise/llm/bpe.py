"""Operator 9: byte-level BPE encoding and decoding with Spark higher-order functions.

Encoding. Documents are cut into pre-tokens in chunks of about ``CHUNK_BYTES`` of text; a chunk numbers its
different words and sends them, packed, to word shards (``messages``). A shard lists its different words once for
all chunks, and a higher-order fold merges each of them: the state is the array of piece ranks, beginning
with those of the word's bytes, and the ranks of all neighbouring pairs; each step replaces the leftmost pair of
least rank, found in a rank map, and looks up the two pairs that are new. The shard answers
every chunk with the ids of its words, and the chunk writes its documents' ids. So a word is merged once in the corpus,
however many documents have it, and no task holds more than a chunk or a shard.

A chunk is shuffled once, for asking and for writing, and is known by a digest of its contents. Should a lost
task be repeated over rows that come in another order, a chunk without answers is an error, not a wrong result;
rows read from files come in one order.

The map has one entry per vocabulary piece, its last merge, in buckets by a multiplicative hash, so
that a look-up compares a few entries. It reaches the expressions by scalar subqueries (arrays of the vocabulary's
size): as literals it would stand, in full, in every description of the plan that Spark's driver keeps. Pre-tokens of more than ``LONG`` bytes are merged by a heap in the shard instead
(same result; a fold would take quadratic time).

Decoding looks the ids' byte strings up in such an array and concatenates them.

Null texts count as empty: no ids, decoded to empty bytes. Ids outside the vocabulary decode to nothing. Repeated
rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lotwise.llm.bpe_words import WHOLE
from lotwise.llm.common import shuffle_partitions
from lotwise.llm.messages import pack, segments, tidy, unpack, word_order, word_parts, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Text of a chunk, and the bytes beyond which a word is merged by heap.
CHUNK_BYTES = 12 << 20
LONG = 1024

_SLICE_UNITS = 1 << 16  # units cut as one text
_BUCKETS = 1 << 15
_FACTOR = 1640531527
_NONE = 1 << 20  # no pair's rank
_END = 65535  # stands before and after a word; no pair with it is in the map


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a rank file (base64 and number on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def last_pair(piece: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two pieces that ranked merges of the piece's own bytes join last; None if they do not reach it."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 2:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return None
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class RankMap:
    """The rank map, each array a table of one row: pairs of ranks to the rank of their concatenation, bytes, pieces.

    A piece is made from one pair only, whatever stands around it: while nothing outside takes one of its bytes, the
    merges inside come in the order they have when the piece stands alone.
    """

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        if max(ranks.values()) >= _END:
            raise ValueError("ranks must be below 65535")
        buckets: list[list[int]] = [[] for _ in range(_BUCKETS)]
        for piece, rank in ranks.items():
            pair = last_pair(piece, ranks)
            if pair:
                key = ranks[pair[0]] << 16 | ranks[pair[1]]
                buckets[key * _FACTOR >> 20 & _BUCKETS - 1].append(key << 17 | rank)
        letters = [ranks[bytes([b])] for b in range(256)]
        if max(letters) > 255:
            raise ValueError("the first 256 ranks must be the single bytes")
        of_bytes = [0] * 65536  # 0 is a byte's rank and no merge's
        for a in range(256):
            for b in range(256):
                of_bytes[letters[a] << 8 | letters[b]] = ranks.get(bytes([a, b]), 0)
        self.of_bytes = spark.createDataFrame([(of_bytes,)], "of_bytes array<int>")
        self.pairs = spark.createDataFrame([(buckets,)], "pairs array<array<bigint>>")
        pieces = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece.decode("latin-1")  # one character a byte
        self.pieces = spark.createDataFrame([(pieces,)], "pieces array<string>")

    def merged(self, words: DataFrame) -> DataFrame:
        """``words`` with a column ``ids``: ``fold`` of ``word``, null where that is null."""
        with_map = words.select("*", self.of_bytes.scalar().alias("of_bytes"), self.pairs.scalar().alias("pairs"))
        # each array is named once, so that its subquery is put in its place and no row carries it
        ids = _let(F.col("pairs"), lambda pairs: _let(F.col("of_bytes"), lambda of_bytes: fold(F.col("word"), pairs, of_bytes)))
        return with_map.select(*words.columns, ids.alias("ids"))

    def decoded(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a column ``decoded``: the bytes of ``ids``."""
        with_map = rows.select("*", self.pieces.scalar().alias("pieces"))
        return with_map.select(*rows.columns, _let(F.col("pieces"), lambda pieces: decode(F.col("ids"), pieces)).alias("decoded"))


def pair_rank(pairs: Column, key: Column) -> Column:
    """Rank of the pair ``left * 65536 + right``; null if its concatenation is no piece."""
    at = F.shiftright(key * F.lit(_FACTOR).cast("long"), 20).bitwiseAND(F.lit(_BUCKETS - 1)).cast("int")
    hit = F.get(F.filter(F.get(pairs, at), lambda e: F.shiftright(e, 17) == key), F.lit(0))
    return hit.bitwiseAND(F.lit((1 << 17) - 1)).cast("int")


def byte_rank(of_bytes: Column, key: Column) -> Column:
    """``pair_rank`` of a pair of bytes, by a direct table; null beside an end of the word."""
    at = F.shiftright(key, 8).bitwiseOR(key.bitwiseAND(F.lit(255))).cast("int")
    return F.when(key.bitwiseAND(F.lit(0xFF00)) == 0, F.nullif(F.get(of_bytes, at), F.lit(0)))


def fold(word: Column, pairs: Column, of_bytes: Column) -> Column:
    """Ids of one word (the array of its bytes' ranks between two ends), by folding ranked merges.

    An entry of the state is a piece's rank below the rank of the pair that it makes with the next piece. A rank is
    made by one pair only, so the least entry is the least pair, and its first place the leftmost one.
    """
    n = F.size(word) - 1
    keys = F.zip_with(F.slice(word, F.lit(1), n), F.slice(word, F.lit(2), n), _key)
    begin = F.concat(
        F.zip_with(F.slice(word, F.lit(1), n), F.transform(keys, lambda k: byte_rank(of_bytes, k)), _entry),
        F.array(F.lit(_NONE << 17 | _END).cast("long")))

    def merge(state, least, i):
        made = F.shiftright(least, 17)
        before, after = _piece(F.get(state, i - 2)), _piece(F.get(state, i + 1))
        pair = F.array(
            F.struct(before.alias("p"), _key(before, made).alias("k")), F.struct(made.alias("p"), _key(made, after).alias("k")))
        new = F.transform(pair, lambda x: _entry(x["p"], pair_rank(pairs, x["k"])))
        return F.concat(F.slice(state, F.lit(1), i - 2), new, F.slice(state, i + 2, F.size(state)))

    def step(state, _):
        def found(least):
            position = F.array_position(state, least).cast("int")
            return F.when(least >= _NONE << 17, state).otherwise(_let(position, lambda i: merge(state, least, i)))

        return _let(F.array_min(state), found)

    return F.aggregate(
        F.slice(word, F.lit(1), n - 2), begin, step,  # a word of n bytes has n - 1 merges at most
        lambda state: F.transform(F.slice(state, F.lit(2), F.size(state) - 2), lambda e: _piece(e).cast("int")))


def decode(ids: Column, pieces: Column) -> Column:
    """Bytes of an array of ids."""
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "", ""), "ISO-8859-1")


def _key(a: Column, b: Column) -> Column:
    return a.cast("long") * 65536 + b


def _entry(piece: Column, pair: Column) -> Column:
    return F.coalesce(pair, F.lit(_NONE)).cast("long") * 131072 + piece


def _piece(entry: Column) -> Column:
    return entry.bitwiseAND(F.lit((1 << 17) - 1))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a very long word: neighbours in linked lists, possible merges in a heap."""
    parts: list = [word[i : i + 1] for i in range(len(word))]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[a + b], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x in (before[i], i):
            if x >= 0 and after[x] < n and parts[x] + parts[after[x]] in ranks:
                heapq.heappush(heap, (ranks[parts[x] + parts[after[x]]], x, parts[x], parts[after[x]]))
    return [ranks[p] for p in parts if p is not None]


class Cutter:
    """Cuts a chunk's texts: first into numbered units, then each different unit into numbered pre-tokens."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """An order of the texts; the pre-tokens of each in that order, the numbers of them all, and the different ones.

        Texts that are cut as a whole come last.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False)
        order = np.argsort(whole, kind="stable")
        lens, numbers, found = self._parts(texts.filter(pa.array(~whole)))
        others = texts.filter(pa.array(whole)).dictionary_encode()
        size, tokens = self._each(others.dictionary.to_pylist())
        size = np.array(size, dtype=np.int64)
        n, start = size[_numbers(others)], (len(found) + np.cumsum(size) - size)[_numbers(others)]
        found = pa.concat_arrays([found, tokens]).dictionary_encode()
        at = np.concatenate([numbers, _ranges(start, n)])
        return order, np.concatenate([lens, n]), _numbers(found)[at], found.dictionary.cast(pa.large_binary())

    def _parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Pre-tokens of each text of plain units, their places in a list of pre-tokens, and that list.

        The different units are cut as one text: pre-tokens do not cross them there either. Those that begin a text, or
        end in white space, are cut one by one.
        """
        split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy()
        parts = split.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
        part, starts = _numbers(parts), starts.astype(np.int64) - starts[0]
        first = starts[:-1]
        spaced = np.delete(part, first)  # each but a text's first part has a space before it
        known = parts.dictionary
        ends = pc.or_(pc.equal(known, ""), pc.ends_with(known, "\n")).to_numpy(zero_copy_only=False)
        after = np.zeros(len(known), dtype=bool)
        after[spaced] = True
        begin = np.zeros(len(known), dtype=bool)
        begin[part[first]] = True
        joined, single = after & ~ends, after & ends
        size = np.zeros((2, len(known)), dtype=np.int64)  # pre-tokens of a part after a space, and at the beginning
        units = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), known, pa.scalar(" ", pa.large_string()))
        lengths, text = word_parts(units.filter(pa.array(joined)))
        unit_ends = np.cumsum(lengths)
        cuts = [0, *unit_ends[_SLICE_UNITS - 1 :: _SLICE_UNITS].tolist(), len(text)]
        _, tokens = self._each(text[a:b].tobytes().decode("utf-8") for a, b in zip(cuts, cuts[1:]))
        token_ends = np.cumsum(pc.binary_length(tokens).to_numpy(zero_copy_only=False))
        if len(text) and token_ends[-1:].tolist() == [len(text)]:
            size[0, joined] = np.diff(np.searchsorted(token_ends, unit_ends, side="right"), prepend=0)
        else:  # nothing to cut, or the pattern leaves characters out
            size[0, joined], tokens = self._each(units.filter(pa.array(joined)).to_pylist())
        size[0, single], more = self._each(units.filter(pa.array(single)).to_pylist())
        size[1, begin], most = self._each(known.filter(pa.array(begin)).to_pylist())
        place = np.zeros_like(size)  # where the pre-tokens of a part begin in the list
        at = 0
        for row, some in ((0, joined), (0, single), (1, begin)):
            n = size[row, some]
            place[row, some] = at + np.cumsum(n) - n
            at += int(n.sum())
        n, start = size[0, part], place[0, part]
        n[first], start[first] = size[1, part[first]], place[1, part[first]]
        lens = np.diff(np.concatenate([[0], np.cumsum(n)])[starts])
        return lens, _ranges(start, n), pa.concat_arrays([tokens, more, most])

    def _each(self, units: Iterable[str]) -> tuple[list[int], pa.Array]:
        """The number of pre-tokens of each unit, and a list of them all."""
        size, tokens, done = [], [], [pa.array([], pa.large_string())]
        for unit in units:
            found = self.find(unit)
            size.append(len(found))
            tokens += found
            if len(tokens) >= _SLICE_UNITS:
                done.append(pa.array(tokens, pa.large_string()))
                tokens = []
        return size, pa.concat_arrays([*done, pa.array(tokens, pa.large_string())])


def _numbers(encoded: pa.DictionaryArray) -> np.ndarray:
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start, ``n`` of them."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


_MESSAGE = "shard long, chunk binary, message binary"


def _chunks(pattern: str, kind: str):
    """Rows (chunk, doc_ids, tokens, words) of about ``CHUNK_BYTES`` of text each."""
    schema = to_arrow_schema(T.StructType.fromDDL(f"chunk binary, doc_ids array<{kind}>, tokens binary, words binary"))

    def finish(cutter, ids, texts):
        order, lens, numbers, words = cutter.cut(pa.concat_arrays([t.cast(pa.large_string()) for t in texts]))
        tokens, words = pack(lens, numbers), pack(*word_parts(words))
        ids = pa.concat_arrays(ids).take(pa.array(order)).to_pylist()
        name = hashlib.blake2b(repr(ids).encode() + tokens + words, digest_size=16).digest()
        return tidy(pa.RecordBatch.from_pydict(
            {"chunk": [name], "doc_ids": [ids], "tokens": [tokens], "words": [words]}, schema=schema))

    def run(batches):
        ids, texts, size, cutter = [], [], 0, Cutter(pattern)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            done = 0
            while done < len(ends):
                before = int(ends[done - 1]) if done else 0
                to = int(np.searchsorted(ends, before + CHUNK_BYTES - size)) + 1  # the text that fills the chunk is in it
                full, to = to <= len(ends), min(to, len(ends))
                ids.append(batch.column(0).slice(done, to - done))
                texts.append(batch.column(1).slice(done, to - done))
                size += int(ends[to - 1]) - before
                if full:
                    yield finish(cutter, ids, texts)
                    ids, texts, size = [], [], 0
                done = to
        if ids:
            yield finish(cutter, ids, texts)

    return run


def _ask(shards: int):
    """The words of each chunk, one message to a shard."""

    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(*unpack(blob))
                order, shard = word_order(words, shards)
                rows = [(s, chunk, pack(*word_parts(words.take(pa.array(order[a:b]))))) for s, a, b in segments(shard)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))],
                        names=["shard", "chunk", "message"])

    return run


def _different(messages: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """For each message the place of its words in the sorted list of all different words, and that list."""
    asked = [words_of(*unpack(m)) for m in messages]
    joined = pa.concat_arrays(asked).dictionary_encode()
    order = pc.sort_indices(joined.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    at = place[joined.indices.to_numpy(zero_copy_only=False)]
    ends = np.cumsum([len(a) for a in asked])
    return np.split(at, ends[:-1]), joined.dictionary.take(pa.array(order)).to_pylist()


def encode(docs: DataFrame, path: str, pattern: str, rank_map: RankMap | None = None) -> DataFrame:
    """doc_id, ids: the token ids of every whole text."""
    spark = docs.sparkSession
    ranks = read_ranks(path)
    rank_map = rank_map or RankMap(spark, ranks)
    shared = spark.sparkContext.broadcast(ranks)  # the vocabulary: a fixed size
    parts, id_field = shuffle_partitions(spark), docs.schema["doc_id"]
    shards = 2 * parts
    kind = id_field.dataType.simpleString()
    ids_type = T.StructType([id_field, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    ids_arrow = to_arrow_schema(ids_type)

    def list_words(table: pa.Table) -> pa.Table:
        _, words = _different(table.column("message").to_pylist())
        letter = [shared.value[bytes([b])] for b in range(256)]
        long = [merge_long(w, shared.value) if len(w) > LONG else None for w in words]
        folded = [None if len(w) > LONG else [_END, *[letter[b] for b in w], _END] for w in words]
        return tidy(pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()] * len(words), pa.int64()),
            "place": pa.array(np.arange(len(words))), "word": pa.array(folded, pa.list_(pa.int32())),
            "long": pa.array(long, pa.list_(pa.int32()))}))

    def answer(messages: pa.Table, merged: pa.Table) -> pa.Table:
        places, _ = _different(messages.column("message").to_pylist())
        ids = merged.column("ids").combine_chunks().take(pc.sort_indices(merged.column("place")))
        starts = ids.offsets.to_numpy()
        flat, count = ids.values.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(starts)
        replies = []
        for at in places:
            n = count[at]
            picked = np.repeat(starts[:-1][at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            replies.append(pack(n, flat[picked]))
        return tidy(pa.table({"shard": messages.column("shard"), "chunk": messages.column("chunk"), "message": pa.array(replies, pa.binary())}))

    def write(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        order, shard = word_order(words_of(*unpack(chunk.column("words")[0].as_py())), shards)
        answers = dict(zip(replies.column("shard").to_pylist(), replies.column("message").to_pylist()))
        count, parts = np.zeros(len(order), dtype=np.int64), []
        for s, a, b in segments(shard):
            n, ids = unpack(answers[s])
            count[order[a:b]] = n
            parts.append(ids.astype(np.int32))
        flat = np.concatenate([*parts, np.zeros(0, dtype=np.int32)])
        start = np.empty(len(order), dtype=np.int64)
        start[order] = np.cumsum(count[order]) - count[order]
        lens, tokens = unpack(chunk.column("tokens")[0].as_py())
        n = count[tokens]
        ids = flat[np.repeat(start[tokens] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(lens)])]
        rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
        doc_ids = chunk.column("doc_ids").combine_chunks().flatten().cast(ids_arrow[0].type)
        return tidy(pa.Table.from_arrays([doc_ids, rows.cast(ids_arrow[1].type)], schema=ids_arrow))

    made = f"chunk binary, doc_ids array<{kind}>, tokens binary, words binary"
    chunks = docs.select("doc_id", "text").mapInArrow(_chunks(pattern, kind), made).repartition(parts, "chunk")
    asked = chunks.select("chunk", "words", "tokens", "doc_ids").mapInArrow(_ask(shards), _MESSAGE).repartition(parts, "shard")
    listed = asked.groupBy("shard").applyInArrow(list_words, "shard long, place long, word array<int>, long array<int>")
    merged = rank_map.merged(listed).select("shard", "place", F.coalesce("long", "ids").alias("ids"))
    replies = asked.groupBy("shard").cogroup(merged.groupBy("shard")).applyInArrow(answer, _MESSAGE)
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(write, ids_type)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per document."""
    rank_map = RankMap(docs.sparkSession, read_ranks(path))
    return rank_map.decoded(encode(docs, path, pattern, rank_map)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), " "), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
