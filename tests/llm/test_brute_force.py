"""Whole operators against plain versions: the pipeline row by row, the forest and its threshold, the hierarchy."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
import helpers as H
from lotwise.llm import bpe, langid, quality

LABELS = "doc_id long, quality int, toxic int"


def _corpus(seed=3):
    """Documents that the rules accept, with copies, near copies, shared lines and null sources; and some that they reject."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]

    def line(n):
        return " ".join(rng.choice(vocab) for _ in range(n)) + "."

    shared = [line(15) for _ in range(3)]
    texts = []
    for i in range(60):
        lines = [line(rng.randint(10, 30)) for _ in range(rng.randint(4, 7))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines)), shared[i % 3])
        if i % 9 == 0:
            lines.append(lines[0])
        texts.append("\n".join(lines))
        if i % 6 == 0:
            texts.append(texts[-1])  # an exact copy
        if i % 5 == 0:  # a near copy: the same words but one, in other lines
            words = texts[-1].replace("\n", " ").split(" ")
            words[len(words) // 2] = "changed"
            at = sorted(rng.sample(range(8, len(words)), 3))
            texts.append("\n".join(" ".join(words[x:y]) for x, y in zip([0, *at], [*at, len(words)])))
    texts += ["too short", "", None, "same words here " * 40, "#### $$ " * 60]
    return [(i, t, "en", [None, "a", "b", "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]


def _line_stage(docs):
    gone = H.dropped_lines(docs)
    out = []
    for d, t, lang, source, n in docs:
        if d in gone:
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
            if not H.WORD.search(t):
                continue
            n = len(t)
        out.append((d, t, lang, source, n))
    return out


def _near_stage(docs):
    sets = {d: H.shingle_set(t) for d, t, *_ in docs}
    comp = H.components(sorted(sets), H.jaccard_links(sets, 85, 100))
    return [r for r in docs if comp[r[0]] == r[0]]


def _mix_stage(docs):
    size = {r[0]: len(H.WORD.findall(r[1] or "")) for r in docs}
    by = defaultdict(list)
    for r in docs:
        by[r[3]].append(r)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[r[0]] for r in by[s]) for s in names}
    target, free, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            free.discard(s)
    target |= {s: weight[s] * level for s in free}
    out = []
    for s in names:
        rate = int(math.floor(target[s] / total[s] * 10**9)) if total[s] else 0
        offset = int(hashlib.md5(f"mix|{s or ''}".encode()).hexdigest()[:8], 16) % 10**9

        def digest(r):
            return hashlib.md5("|".join("\\N" if v is None else str(v) for v in r).encode()).hexdigest()

        order = sorted(by[s], key=lambda r: (len(f"{size[r[0]]:b}"), digest(r)))
        for k, r in enumerate(order, 1):
            out += [r] * ((k * rate + offset) // 10**9 - ((k - 1) * rate + offset) // 10**9)
    return out


def test_pipeline_rows(spark, tmp_path):
    rows = _corpus()
    labels = [(r[0], int(len((r[1] or "").split(" ")) > 45 and "same words" not in r[1] and "##" not in r[1]), 0) for r in rows[::2]]
    spark.createDataFrame(rows, H.DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    verdict = quality.assess(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))).collect()
    kept = {r.doc_id for r in verdict if r.kept}  # compared with its own plain version below
    docs = [r for r in rows if r[0] in kept]
    assert 50 < len(docs) < len(rows)
    for stage in (_line_stage, _near_stage, _mix_stage):
        before = len(docs)
        docs = stage(docs)
        assert docs and len(docs) != before
    library = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for d, t, *_ in docs:
        ids = library.encode_ordinary(t or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want[d, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = Counter(tuple(r) for r in C.run(spark, str(tmp_path)).collect())
    assert got == want


def _path_length(forest, tree, x):
    """Steps from the root to the leaf of ``x``, and what the leaf adds, one node at a time."""
    node = 0
    while forest.feature[tree, node] >= 0:
        node = 2 * node + (2 if x[forest.feature[tree, node]] >= forest.cut[tree, node] else 1)
    return forest.length[tree, node]


def test_forest_and_threshold(spark):
    rows = _corpus(seed=9)
    rng = random.Random(4)
    labels = [(i, int(rng.random() < (0.9 if i < 75 else 0.1)), 0) for i in range(len(rows))]
    docs, marks = spark.createDataFrame(rows, H.DOCS), spark.createDataFrame(labels, LABELS)
    stats = quality.with_statistics(docs).collect()
    forest = quality.grow(spark.createDataFrame(stats))
    assert all(forest.length[t, 0] >= 0 for t in range(len(forest.feature)))
    normal = quality.expected_length(forest.tree_rows)
    score = {}
    for r in stats:
        paths = [_path_length(forest, t, r.features) for t in range(len(forest.feature))]
        score[r.doc_id] = 2.0 ** (-(sum(paths) / len(paths)) / normal) if r.n_words else 1.0
    got = {r.doc_id: r for r in quality.assess(docs, marks).collect()}
    for d, s in score.items():
        assert abs(got[d].score - s) < 1e-9
    # the threshold: of all cuts between scores, one of the highest balanced accuracy over the labelled rows that pass the rules
    passed = [(score[d], q) for d, q, _ in labels if not got[d].base_failed]
    good, bad = sum(q for _, q in passed), sum(1 - q for _, q in passed)

    def accuracy(limit):
        return sum(q for s, q in passed if s <= limit) / good + sum(1 - q for s, q in passed if s > limit) / bad

    width = 1 / quality.BINS
    best = max(accuracy(s + width) for s, _ in passed)
    assert abs(sum(got[d].kept for d, q, _ in labels if q and not got[d].base_failed) / good
               + sum(not got[d].kept for d, q, _ in labels if not q and not got[d].base_failed) / bad - best) < 0.05
    limit = max(got[d].score for d in got if got[d].kept)
    assert all(r.kept == (not r.base_failed and r.score <= limit) for r in got.values())


def _plain_machine_vote(models, x):
    """One-versus-one by definition: a vote for each machine, then the larger sum of margins."""
    votes, total = Counter(), Counter()
    for i, j, m in models.pairs:
        margin = sum(float(a) * float(b) for a, b in zip(m.w, x)) + m.bias
        votes[i if margin > 0 else j] += 1
        total[i] += margin
        total[j] -= margin
    return models.classes[max(range(len(models.classes)), key=lambda k: (votes[k], total[k]))]


def test_hierarchy_votes_and_machines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    learn = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None]
    assert len(learn) < langid.PER_LANG  # the whole learning part is the sample here
    pairs = sorted((r.lang, langid.features(r.text).astype(np.float16).tobytes()) for r in {(r.doc_id, r.text): r for r in learn}.values()
                   if langid.features(r.text) is not None)
    model = langid.Hierarchy(np.array([np.frombuffer(v, dtype=np.float16) for _, v in pairs]).astype(np.float32), [c for c, _ in pairs])
    for r in rows[::5]:
        x = langid.features(r.text) if r.text is not None else None
        if x is None:
            assert got[r.doc_id].lang_pred == "und"
            continue
        family = _plain_machine_vote(model.top, x)
        assert got[r.doc_id].lang_pred == _plain_machine_vote(model.inner[family], x)
        assert langid.family(got[r.doc_id].lang_pred) == family
    # a machine is the least of its objective: no nearby weights do better
    _, _, machine = model.top.pairs[0]
    families = [langid.family(c) for c, _ in pairs]
    a, b = model.top.classes[model.top.pairs[0][0]], model.top.classes[model.top.pairs[0][1]]
    x = np.array([np.frombuffer(v, dtype=np.float16).astype(np.float64) for (_, v), f in zip(pairs, families) if f in (a, b)])
    y = np.array([1.0 if f == a else -1.0 for f in families if f in (a, b)])

    def objective(w, bias):
        slack = np.maximum(0, 1 - y * (x @ w + bias))
        return 0.5 * (w @ w + bias * bias) + 10.0 * (slack * slack).sum()

    w, bias = machine.w.astype(float), machine.bias
    least, rng = objective(w, bias), np.random.default_rng(0)
    for _ in range(30):
        step = rng.normal(size=len(w) + 1)
        step *= 0.05 / np.linalg.norm(step)
        assert objective(w + step[:-1], bias + step[-1]) > least
