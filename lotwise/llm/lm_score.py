"""Operator 12: scores of texts under an n-gram model kept in Elias-Fano tries.

The model has three orders with hierarchical smoothing (``MU2`` and ``MU3`` are the weights of the lower order):

    p1(w)      = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p2(w|v)    = (c(v w) + MU2 p1(w)) / (c(v) + MU2)
    p3(w|u, v) = (c(u v w) + MU3 p2(w|v)) / (c(u v) + MU3)

It learns from every document outside the held-out fold, without a cap, and grows with them; so it is never held in
one place. The n-grams that begin with one pair of words lie in one of many shards, dealt by a hash of the pair, so a
frequent word is spread too. A shard's trie (``elias_fano.Trie``) is written to a file that the task maps into memory
and asks; probabilities and back-off weights are 16-bit codes (within 0.03 %).

Texts and shards meet by messages, each packed into one binary value:

1. documents are cut into chunks of about ``CHUNK_BYTES``; a chunk lists its different words;
2. the words of all chunks go to word shards, which sum the counts and answer with an id and a count for each;
3. a chunk sends its different triples, sorted and as differences, with their training counts, to the shards of their
   pairs; a shard sums the counts, builds its trie, looks the triples of each chunk up in it and answers with what the
   codes say, written as counts (small numbers, which pack well);
4. the chunk, with the answers, scores its documents.

A word or triple is sent once per chunk, however often it occurs. Chunks are staged, so their numbering cannot change
under a retry, and shuffled once for both uses. The driver sees three totals.

Null texts are empty (one token, the end). A null doc_id belongs to no fold: it is not held out and is learned from.
Repeated rows are learned from and scored each. Without training documents every probability of a word
is 1 and all scores are 0. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import crc_mod, shuffle_partitions, staged
from lotwise.llm.elias_fano import Trie, decode_probability
from lotwise.llm.messages import pack, segments, tidy, unpack, word_order, word_parts, words_of
from lotwise.llm.word_cuts import byte_set, cut, mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Weights of the lower order, in counts.
MU2, MU3 = 500.0, 12.0
#: Text of a chunk, and the training tokens for which there is one shard more.
CHUNK_BYTES = 4 << 20
SHARD_TOKENS = 2_000_000

GAP, NO_FENCE = byte_set(b" \t\n\x0b\x0c\r"), byte_set(b"")
#: Ids of unknown words, begin, end, and what stands after the end; words follow.
UNKNOWN, BEGIN, END, AFTER, FIRST = 0, 1, 2, 3, 4

_SCORES = "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative numbers in four bytes each where they fit."""
    return a.astype(np.uint32) if not len(a) or a.max() < 1 << 32 else a


# --- 1: chunks


def _chunk(number: int, ids, held, texts) -> pa.RecordBatch:
    held = np.array(held, dtype=bool)
    c = cut(texts, GAP, NO_FENCE)
    counts = np.bincount(c.ids[~held[c.doc]], minlength=len(c.words))
    blob = pack(np.bincount(c.doc, minlength=len(texts)), c.ids, *word_parts(c.words), counts)
    train = int((~held).sum())
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([ids.tolist()], pa.list_(ids.type)), pa.array([held.tolist()], pa.list_(pa.bool_())),
         pa.array([int(counts.sum()) + train], pa.int64()), pa.array([train], pa.int64()), pa.array([blob], pa.binary())],
        names=["chunk", "ids", "held", "tokens", "train_docs", "blob"])


def chunks(docs: DataFrame, fold) -> DataFrame:
    """Rows (chunk, ids, held, tokens, train_docs, blob), staged. ``fold`` is true for held-out rows."""
    rows = docs.select("doc_id", fold.alias("held"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            texts_here = batch.column(2).cast(pa.binary()).to_pylist()
            done = 0
            for i, (h, t) in enumerate(zip(batch.column(1).to_pylist(), texts_here)):
                held.append(h)
                texts.append(t)
                size += len(t)
                if size >= CHUNK_BYTES:
                    yield _chunk(number, pa.concat_arrays([*ids, batch.column(0).slice(done, i + 1 - done)]), held, texts)
                    number, done = number + 1, i + 1
                    ids, held, texts, size = [], [], [], 0
            ids.append(batch.column(0).slice(done))
        if texts:
            yield _chunk(number, pa.concat_arrays(ids), held, texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = f"chunk long, ids array<{kind}>, held array<boolean>, tokens long, train_docs long, blob binary"
    return staged(rows.mapInArrow(run, made), "lm_chunks")


# --- 2: words


_WORDS, _TRIPLES = 0, 1
_MESSAGE = "shard long, chunk long, message binary"


def _messages(rows) -> pa.RecordBatch:
    shard, chunk, message = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(shard, pa.int64()), pa.array(chunk, pa.int64()), pa.array(message, pa.binary())], names=["shard", "chunk", "message"])


def _ask_words(shards: int):
    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, _, lengths, data, counts = unpack(blob)
                words = words_of(lengths, data)
                order, shard = word_order(words, shards)
                rows = []
                for s, a, b in segments(shard):
                    rows.append((s, chunk, pack(*word_parts(words.take(pa.array(order[a:b]))), counts[order[a:b]])))
                if rows:
                    yield _messages(rows)

    return run


_WORD_REPLY = "shard long, chunk long, message binary, tokens long, types long"


def _answer_words(shards: int):
    """Sum the counts of a shard's words; ids are dealt by falling count, so frequent words have small ones."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        asked = [unpack(m) for m in table.column("message").to_pylist()]
        words = pa.concat_arrays([words_of(lengths, data) for lengths, data, _ in asked]).dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False)
        count = np.zeros(len(words.dictionary), dtype=np.int64)
        np.add.at(count, at, np.concatenate([c for *_, c in asked]))
        rank = np.empty(len(count), dtype=np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        ids = np.where(count > 0, FIRST + rank * shards + shard, UNKNOWN)
        replies, end = [], 0
        for lengths, *_ in asked:
            mine = at[end : end + len(lengths)]
            replies.append(pack(ids[mine], count[mine]))
            end += len(lengths)
        once = np.zeros(len(asked), dtype=np.int64)
        once[0] = 1
        return pa.table({
            "shard": table.column("shard"), "chunk": table.column("chunk"), "message": pa.array(replies, pa.binary()),
            "tokens": pa.array(once * count.sum()), "types": pa.array(once * (count > 0).sum())})

    return run


def _ids_of(lengths: np.ndarray, data: np.ndarray, replies: dict, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of a chunk's words."""
    order, shard = word_order(words_of(lengths, data), shards)
    ids, counts = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
    for s, a, b in segments(shard):
        ids[order[a:b]], counts[order[a:b]] = unpack(replies[s])
    return ids, counts


# --- 3: triples


class Triples:
    """The different triples of a chunk, by shard; ``at`` is the triple, ``pair_at`` the pair at every place."""

    def __init__(self, lens, tokens, ids, counts, held: np.ndarray, shards: int, train_docs: int):
        self.lens, n = lens, len(ids)
        self.ids = np.concatenate([ids, [BEGIN, END, AFTER]])
        self.counts = np.concatenate([counts, [train_docs, train_docs, 0]])
        size = self.lens + 4  # begin, begin, words, end, after
        end = np.cumsum(size)
        start = end - size
        seq = np.empty(int(size.sum()), dtype=np.int32)  # fewer words than bytes of a chunk
        seq[start] = seq[start + 1] = n
        seq[end - 2], seq[end - 1] = n + 1, n + 2
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        place = (np.arange(len(seq)) - start[doc]).astype(np.int32)
        seq[(place > 1) & (place < size[doc] - 2)] = tokens
        g, rank = np.unique(self.ids, return_inverse=True)
        ranked, width = rank[seq], len(g)
        first = np.flatnonzero(place < size[doc] - 2).astype(np.int32)
        self.doc, self.seq, self.first = doc[first], seq, first
        del doc, place
        pairs, at = np.unique(ranked[first] * width + ranked[first + 1], return_inverse=True)
        triples, self.at = np.unique(at * width + ranked[first + 2], return_inverse=True)
        del ranked
        self.pair_at, self.at = at.astype(np.int32), self.at.astype(np.int32)
        pair = triples // width
        u, v, w = g[pairs // width], g[pairs % width], g[triples % width]
        context = np.zeros(width, dtype=np.int64)
        context[rank] = np.where(self.ids == UNKNOWN, 0, self.counts)
        shard = (mixed(u.astype(np.uint64) * np.uint64(5) + mixed(v.astype(np.uint64))) % np.uint64(shards)).astype(np.int64)
        self.pair_order = np.argsort(shard, kind="stable")
        self.triple_order = np.argsort(shard[pair], kind="stable")
        self.pair_shard, self.triple_shard = shard[self.pair_order], shard[pair][self.triple_order]
        self.u, self.v, self.w = u[self.pair_order], v[self.pair_order], w[self.triple_order]
        self.context = context[pairs // width][self.pair_order]
        self.size3 = np.bincount(pair, minlength=len(pairs))[self.pair_order]
        self.train = np.bincount(self.at[~held[self.doc]], minlength=len(triples))[self.triple_order]

    def segments(self):
        """(shard, its pairs, its triples) as slices of the ordered arrays."""
        triple = {s: slice(a, b) for s, a, b in segments(self.triple_shard)}
        for s, a, b in segments(self.pair_shard):
            yield s, slice(a, b), triple[s]


def _chunk_triples(left: pa.Table, replies: dict, shards: int, train_docs: int) -> Triples:
    lens, tokens, lengths, data, _ = unpack(left.column("blob")[0].as_py())
    held = np.array(left.column("held")[0].as_py(), dtype=bool)
    return Triples(lens, tokens, *_ids_of(lengths, data, replies, shards), held, shards, train_docs)


def _by_shard(right: pa.Table, kind: int) -> dict:
    rows = zip(*(right.column(c).to_pylist() for c in ("kind", "shard", "message")))
    return {s: m for k, s, m in rows if k == kind}


def _steps(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Differences to the value before, the value itself where a run begins."""
    return np.where(new, x, x - np.concatenate([[0], x[:-1]])) if len(x) else x


def _unsteps(d: np.ndarray, new: np.ndarray) -> np.ndarray:
    total = np.cumsum(d)
    starts = np.flatnonzero(new)
    return total - np.repeat(total[starts] - d[starts], np.diff(np.append(starts, len(d))))


def _runs(*columns) -> np.ndarray:
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def pack_triples(u, v, context, size3, w, train) -> bytes:
    new_u = _runs(u)
    new_pair = np.zeros(len(w), dtype=bool)
    new_pair[np.cumsum(size3) - size3] = True
    return pack(_steps(u, np.zeros(len(u), dtype=bool)), _steps(v, new_u), context[new_u], size3 - 1, _steps(w, new_pair), train)


def unpack_triples(blob: bytes):
    du, dv, context, size3, dw, train = unpack(blob)
    u, size3 = np.cumsum(du), size3 + 1
    new_u = _runs(u)
    new_pair = np.zeros(len(dw), dtype=bool)
    new_pair[np.cumsum(size3) - size3] = True
    return u, _unsteps(dv, new_u), np.repeat(context, np.diff(np.append(np.flatnonzero(new_u), len(u)))), size3, _unsteps(dw, new_pair), train


def _ask_triples(shards: int, train_docs: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t = _chunk_triples(left, _by_shard(right, _WORDS), shards, train_docs)
        chunk = left.column("chunk")[0].as_py()
        rows = [(s, chunk, pack_triples(t.u[p], t.v[p], t.context[p], t.size3[p], t.w[q], t.train[q])) for s, p, q in t.segments()]
        del t
        return tidy(pa.Table.from_batches([_messages(rows)]))

    return run


class _Asked:
    """All messages of a shard at once: the different triples, sorted, and where each triple of a message is among them."""

    def __init__(self, messages: list[bytes]):
        parts = [unpack_triples(m) for m in messages]
        self.size3 = [p[3] for p in parts]
        u, v, context = (np.concatenate([np.repeat(_narrow(p[k]), p[3]) for p in parts]) for k in range(3))
        w, train = (np.concatenate([_narrow(p[k]) for p in parts]) for k in (4, 5))
        del parts
        order = np.lexsort((w, v, u))
        u, v, w = u[order], v[order], w[order]
        starts = np.flatnonzero(_runs(u, v, w))
        self.at = np.empty(len(order), dtype=np.int32)
        self.at[order] = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(order))))
        self.u, self.v, self.w, self.context = (x.astype(np.int64) for x in (u[starts], v[starts], w[starts], context[order][starts]))
        self.count = np.add.reduceat(train[order], starts, dtype=np.int64)

    def trie(self) -> Trie:
        live = self.count > 0
        return Trie.build(*(x[live] for x in (self.u, self.v, self.w, self.count, self.context)), MU2, MU3)


def _answer_triples(table: pa.Table) -> pa.Table:
    """Build the shard's trie, look every different triple up once, and write the answers of each message."""
    asked = _Asked(table.column("message").to_pylist())
    with tempfile.TemporaryFile() as file:
        asked.trie().save(file)
        trie = Trie.mapped(np.memmap(file, dtype=np.uint8, mode="r"))
        new = _runs(asked.u, asked.v)
        pair = np.flatnonzero(new)
        size3 = np.diff(np.append(pair, len(new)))
        prob2, _, prob3 = trie.lookup(asked.u[pair], asked.v[pair], size3, asked.w)
    count2 = np.repeat(np.rint(decode_probability(prob2) * (asked.context[pair] + MU2)), size3)
    count3 = np.rint(decode_probability(prob3) * (count2 + MU3)).astype(np.int64)
    replies, end, count2 = [], 0, count2.astype(np.int64)
    for size3 in asked.size3:
        n = int(size3.sum())
        mine = asked.at[end : end + n]
        replies.append(pack(count2[mine[np.cumsum(size3) - size3]], count3[mine]))
        end += n
    del trie, asked
    return tidy(pa.table({"shard": table.column("shard"), "chunk": table.column("chunk"), "message": pa.array(replies, pa.binary())}))


def _levels(table: pa.Table) -> pa.Table:
    with tempfile.TemporaryFile() as file:
        _Asked(table.column("message").to_pylist()).trie().save(file)
        file.seek(0)
        levels = file.read()
    return pa.table({"shard": table.column("shard").slice(0, 1), "levels": pa.array([levels], pa.binary())})


# --- 4: scores


def _score(shards: int, train_docs: int, train_tokens: int, types: int, ids_type: pa.DataType):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = np.array(left.column("held")[0].as_py(), dtype=bool)
        t = _chunk_triples(left, _by_shard(right, _WORDS), shards, train_docs)
        replies = _by_shard(right, _TRIPLES)
        count2, prob3 = np.zeros(len(t.u)), np.zeros(len(t.w))
        context = np.zeros(len(t.u))
        for s, p, q in t.segments():
            two, three = unpack(replies[s])
            count2[t.pair_order[p]], context[t.pair_order[p]] = two, t.context[p]
            prob3[t.triple_order[q]] = three / (np.repeat(two, t.size3[p]) + MU3)
        prob2, back2 = count2 / (context + MU2), MU3 / (count2 + MU3)
        here = np.flatnonzero(np.diff(t.doc, append=-1) == 0)  # all but what follows the end of a text
        doc, at = t.doc[here], t.first[here]
        count = t.counts[t.seq[at + 2]].astype(float)
        p1 = (count + 0.5) / (train_tokens + 0.5 * (types + 1))
        p2 = prob2[t.pair_at[here + 1]] + MU2 / (t.counts[t.seq[at + 1]] + MU2) * p1
        p3 = prob3[t.at[here]] + back2[t.pair_at[here]] * p2
        n, lens = len(t.lens), t.lens + 1
        del t
        ids = left.column("ids").combine_chunks().flatten()
        return tidy(pa.table({
            "doc_id": ids.cast(ids_type), "held_out": pa.array(held), "n_tokens": pa.array(lens),
            "n_known": pa.array(np.bincount(doc[count > 0], minlength=n)),
            "train_tokens": pa.array(np.full(n, train_tokens, dtype=np.int64)),
            "base_score": pa.array(np.bincount(doc, weights=np.log10(p1), minlength=n)),
            "score": pa.array(np.bincount(doc, weights=np.log10(p3), minlength=n))}))

    return run


def held_out_fold(modulus: int = 5, remainder: int = 1):
    """The documents that are not learned from."""
    return F.coalesce(crc_mod("doc_id", modulus) == remainder, F.lit(False))


class _Encoded:
    """Chunks with word ids and counts, and the totals of the training documents."""

    def __init__(self, docs: DataFrame, fold):
        spark = docs.sparkSession
        parts = chunks(docs, fold)
        totals = parts.agg(F.sum("tokens").alias("t"), F.sum("train_docs").alias("d")).first()
        self.train_docs = int(totals.d or 0)
        self.shards = shards = max(2 * shuffle_partitions(spark), -(-int(totals.t or 0) // SHARD_TOKENS))
        asked = parts.select("chunk", "blob").mapInArrow(_ask_words(shards), _MESSAGE)
        replies = staged(asked.groupBy("shard").applyInArrow(_answer_words(shards), _WORD_REPLY), "lm_words")
        found = replies.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
        # the end of a text counts as a word, once per training document
        self.train_tokens = int(found.n or 0) + self.train_docs
        self.types = int(found.v or 0) + (self.train_docs > 0)
        self.parts = parts.select("chunk", "ids", "held", "blob").groupBy("chunk")
        self.words = replies.select("chunk", "shard", F.lit(_WORDS).alias("kind"), "message")
        self.asked = self.parts.cogroup(self.words.groupBy("chunk")).applyInArrow(
            _ask_triples(shards, self.train_docs), _MESSAGE)


def model_levels(docs: DataFrame, fold=None) -> DataFrame:
    """The model's tries, one row (shard, levels) each; ``elias_fano.Trie.mapped`` reads the levels."""
    e = _Encoded(docs, held_out_fold() if fold is None else fold)
    return e.asked.groupBy("shard").applyInArrow(_levels, "shard long, levels binary")


def score_corpus(docs: DataFrame, fold=None) -> DataFrame:
    """One row per document: the log10 probabilities of its text under single words and under the model."""
    e = _Encoded(docs, held_out_fold() if fold is None else fold)
    answered = e.asked.groupBy("shard").applyInArrow(_answer_triples, _MESSAGE)
    kind = docs.schema["doc_id"].dataType
    ids_type = {"long": pa.int64(), "integer": pa.int32()}.get(kind.typeName(), pa.string())
    scored = _score(e.shards, e.train_docs, e.train_tokens, e.types, ids_type)
    replies = e.words.unionByName(answered.select("chunk", "shard", F.lit(_TRIPLES).alias("kind"), "message"))
    return e.parts.cogroup(replies.groupBy("chunk")).applyInArrow(scored, _SCORES.format(kind.simpleString()))
