"""Operator 2: near-duplicate vectors by product quantisation.

Vectors are scaled to unit length, so that cosine >= 0.9 is an angle of at most arccos(0.9). Equal
vectors are one class from the start. A coarse codebook gives every class an inverted list; inside
its list a class is stored as a residual code, one byte per subspace. As a query, a class looks into the
``PROBES`` lists of nearest centres, and besides into every list with a core that can hold a link: the core of a
list is its members within ``CORE`` of its direction, and by the triangle inequality those matter whose direction is within
arccos(0.9) plus the core's radius. So a large group of near copies, whose lists are narrow, is
searched whole however many lists it fills, while vectors spread evenly cost a fixed number of lists. In a list, the
angles of the members rule out some of them the same way, and a table of subspace distances
gives the asymmetric distance to each code; as the quantisation error of every code is known, this
rules out only what is certainly too far. Everything else is reranked by exact cosine in double
precision: no false links, and all links but those of spread vectors whose lists are not among each other's probes
(measured recall at cosine 0.9 to 0.92: 0.98 and more, see the README and the tests).

Lists that lie together are packed into cells of up to ``BLOCK`` classes, a longer list is cut into blocks
by hash, and one task compares two blocks, so a hot list is spread over many tasks. Each pair is seen in
one task only. A task returns counts per class and the links that join classes within the task, never all
pairs. A class travels to the cells of its probes, ``PROBES`` copies at most besides those of narrow lists. The number of lists
follows the table up to a quarter of the sample (524,288 classes); beyond, lists grow longer.

Codebooks are fitted on the driver on a bounded sample (the first ``SAMPLE`` classes by hash); every
vector is indexed. Vectors of different lengths are indexed apart and never linked. Null, empty
or zero vectors and vectors with null or non-finite components link with nothing (n_links 0, own
component, kept). Repeated rows link with each other. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import staged
from lotwise.llm.components import connected_components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.9
#: Most classes the codebooks are fitted on (a documented bound).
SAMPLE = 16_384
#: Classes per list aimed at, most rows of a block, blocks aimed at in a table of fewer rows.
LIST_ROWS = 128
BLOCK = 16_384
CELLS = 12
#: Lists a class looks into, and the angle within which members of a list are its core.
PROBES = 32
CORE = float(np.radians(30))
#: Widest angle of a link, with room for rounding.
WIDEST = float(np.arccos(THRESHOLD)) + 1e-6
SUBSPACES = 8
CODES = 64


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angles between the unit vectors of two arrays."""
    return np.arccos(np.clip(x @ y.T, -1, 1))


def nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """Numbers of the ``k`` nearest centres of each row, nearest first."""
    d = (centres * centres).sum(1) - 2 * (x @ centres.T)
    if k == 1:
        return d.argmin(1)[:, None]
    near = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1, kind="stable"), 1)


def mix(ids: np.ndarray) -> np.ndarray:
    """Non-negative numbers that deal the ids of a long list over its blocks (ids are hashes)."""
    return (ids.astype(np.int64).view(np.uint64) >> np.uint64(20)).astype(np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)[:, 0]
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
        centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


class Codebook:
    """Coarse centres and, per subspace of the residuals, ``CODES`` centres."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = k_means(sample, max(1, min(lists, len(sample) // 4 or 1)))
        length = np.linalg.norm(self.coarse, axis=1, keepdims=True)
        some = np.eye(1, sample.shape[1])  # any direction serves a centre at the origin
        self.directions = np.where(length > 1e-9, self.coarse / np.maximum(length, 1e-9), some)
        residual = sample - self.coarse[nearest(sample, self.coarse)[:, 0]]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.fine = [k_means(residual[:, p], min(CODES, len(sample)), rounds=8) for p in self.parts]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and quantisation errors (length of what the codes leave out)."""
        residual = x - self.coarse[own]
        codes = np.stack([nearest(residual[:, p], f)[:, 0] for p, f in zip(self.parts, self.fine)], 1).astype(np.uint8)
        made = np.concatenate([f[codes[:, i]] for i, f in enumerate(self.fine)], 1)
        return codes, np.linalg.norm(residual[:, np.concatenate(self.parts)] - made, axis=1)

    def asymmetric(self, queries: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Distances between queries and the codes of one list, summed from subspace tables."""
        residual = queries - self.coarse[centre]
        total = np.zeros((len(queries), len(codes)))
        for i, (p, f) in enumerate(zip(self.parts, self.fine)):
            q = residual[:, p]
            table = (q * q).sum(1)[:, None] + (f * f).sum(1) - 2 * (q @ f.T)
            total += table[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0))


def _cells(book: Codebook, n: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each list, neighbours along the main axis of the directions together; blocks of each cell."""
    block = max(1, min(BLOCK, -(-total // CELLS)))
    axis = np.linalg.svd(book.directions - book.directions.mean(0), full_matrices=False)[2][0]
    cell, sizes = np.zeros(len(n), dtype=np.int64), [0]
    for i in np.argsort(book.directions @ axis, kind="stable"):
        if sizes[-1] and sizes[-1] + n[i] > block:
            sizes.append(0)
        cell[i] = len(sizes) - 1
        sizes[-1] += int(n[i])
    return cell, np.maximum(-(-np.array(sizes) // block), 1)


def compare(book: Codebook, q: pd.DataFrame, e: pd.DataFrame, same: bool) -> tuple[dict, list]:
    """Links between two blocks (``same``: inside one): extra links per class, links that join classes."""
    links: list[tuple[int, int]] = []
    ids = np.concatenate([q["id"].to_numpy(), e["id"].to_numpy()])
    qx, ex = (np.frombuffer(b"".join(f["x"]), dtype=np.float64).reshape(len(f), -1) for f in (q, e))
    q_n, e_n = q["n"].to_numpy(), e["n"].to_numpy()
    codes = np.frombuffer(b"".join(e["codes"]), dtype=np.uint8).reshape(len(e), -1)
    far = np.sqrt(2 - 2 * THRESHOLD) + 1e-9 + e["error"].to_numpy()
    angle, own = e["angle"].to_numpy(), e["own"].to_numpy()
    q_more, e_more = np.zeros(len(q), dtype=np.int64), np.zeros(len(e), dtype=np.int64)
    label = np.arange(len(q) + len(e))
    if same:
        label[len(q):] = label[: len(q)]
    order = np.lexsort((angle, own))
    cuts = np.flatnonzero(np.diff(own[order])) + 1
    rings = []
    for one in np.split(order, cuts):  # the core and the rest of each list, by angle
        inner = int(np.searchsorted(angle[one], CORE, side="right"))
        for part in (one[:inner], one[inner:]):
            rings += [r for r in np.array_split(part, max(1, min(4, len(part) // 16))) if len(r)]
    probes = np.frombuffer(b"".join(q["probes"]), dtype=np.int32).reshape(len(q), -1)
    to_centre = angles(qx, book.directions[[own[r[0]] for r in rings]])
    for ring, away in zip(rings, to_centre.T):
        near = (away >= angle[ring[0]] - WIDEST) & (away <= angle[ring[-1]] + WIDEST)
        asking = np.flatnonzero(near)
        if angle[ring[0]] > CORE:
            asking = asking[(probes[asking] == own[ring[0]]).any(1)]
        step = max(16, 500_000 // len(ring))
        for start in range(0, len(asking), step):
            rows = asking[start : start + step]
            i, j = np.nonzero(book.asymmetric(qx[rows], own[ring[0]], codes[ring]) <= far[ring])
            if len(i) * 8 > len(rows) * len(ring):  # dense: one product of matrices
                ok = (qx[rows] @ ex[ring].T)[i, j] >= THRESHOLD
            else:
                ok = np.einsum("ij,ij->i", qx[rows[i]], ex[ring[j]]) >= THRESHOLD
            i, j = rows[i[ok]], ring[j[ok]]
            if same:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            q_more += np.bincount(i, e_n[j], len(q)).astype(np.int64)
            e_more += np.bincount(j, q_n[i], len(e)).astype(np.int64)
            apart = label[i] != label[len(q) + j]
            for a, b in zip(i[apart].tolist(), (len(q) + j[apart]).tolist()):
                la, lb = label[a], label[b]
                if la != lb:
                    label[label == max(la, lb)] = min(la, lb)
                    links.append((int(ids[a]), int(ids[b])))
    more = np.concatenate([q_more, e_more])
    counts: dict[int, int] = {}
    for a in np.flatnonzero(more).tolist():
        counts[int(ids[a])] = counts.get(int(ids[a]), 0) + int(more[a])
    return counts, links


def _index_one(classes: DataFrame, size: int, total: int) -> DataFrame:
    """Rows (u, v, n): class u has n more links (v null), or classes u and v are linked (n null)."""
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(SAMPLE).select("x").collect()
    book = Codebook(np.array([r["x"] for r in sample]), -(-total // LIST_ROWS))
    shared = spark.sparkContext.broadcast(vars(book))  # fixed size

    def restored():
        b = Codebook.__new__(Codebook)
        vars(b).update(shared.value)
        return b

    def assign(batches):
        b = restored()
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["x"].tolist())
            own = nearest(x, b.coarse)[:, 0]
            codes, error = b.encode(x, own)
            angle = np.arccos(np.clip(np.einsum("ij,ij->i", x, b.directions[own]), -1, 1))
            yield pdf.assign(x=[r.tobytes() for r in x], own=own, codes=[c.tobytes() for c in codes], error=error, angle=angle)

    schema = "id long, n long, x binary, own long, codes binary, error double, angle double"
    indexed = staged(classes.select("id", "n", "x").mapInPandas(assign, schema), "pq_index")
    core = F.max(F.when(F.col("angle") <= CORE, F.col("angle")))
    lists = indexed.groupBy("own").agg(F.count(F.lit(1)).alias("rows"), core.alias("radius")).collect()  # one row per list
    rows, radius = np.zeros(len(book.coarse), dtype=np.int64), np.full(len(book.coarse), -np.inf)
    for r in lists:
        rows[r["own"]] = r["rows"]
        radius[r["own"]] = -np.inf if r["radius"] is None else r["radius"]
    cell, parts = _cells(book, rows, total)
    first = np.cumsum(parts) - parts  # the number of a cell's first block
    plan = spark.sparkContext.broadcast((radius, cell, parts, first))

    def reach(batches):
        b = restored()
        radius, cell, parts, first = plan.value
        narrow = np.flatnonzero(radius > -np.inf)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.frombuffer(b"".join(pdf["x"]), dtype=np.float64).reshape(len(pdf), -1)
            probes = nearest(x, b.coarse, min(PROBES, len(b.coarse)))
            cells = np.zeros((len(x), len(parts)), dtype=bool)
            cells[np.arange(len(x))[:, None], cell[probes]] = True
            for s in range(0, len(x), 1000):
                row, at = np.nonzero(angles(x[s : s + 1000], b.directions[narrow]) <= WIDEST + radius[narrow])
                cells[s + row, cell[narrow[at]]] = True
            at = cell[pdf["own"].to_numpy()]
            block = first[at] + mix(pdf["id"].to_numpy()) % parts[at]
            cells[np.arange(len(x)), at] = True
            probes = [p.astype(np.int32).tobytes() for p in probes]
            yield pdf.assign(block=block, probes=probes, cells=[np.flatnonzero(c) for c in cells])

    reaching = indexed.mapInPandas(reach, schema + ", block long, probes binary, cells array<long>")
    blocks = spark.createDataFrame([(i, int(f), int(f + p - 1)) for i, (f, p) in enumerate(zip(first, parts))], "cell long, low long, high long")
    met = reaching.withColumn("cell", F.explode("cells")).drop("cells").join(blocks, "cell")
    met = met.withColumn("other", F.explode(F.sequence("low", "high")))
    met = met.select(
        F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("block") <= F.col("other")).alias("asks"),
        "id", "n", "x", "own", "codes", "error", "angle", "probes")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        asks = pdf["asks"].to_numpy(dtype=bool)
        q, e = (pdf, pdf) if same else (pdf[asks], pdf[~asks])
        if not len(q) or not len(e):
            return pd.DataFrame({"u": [], "v": [], "n": []})
        counts, links = compare(restored(), q, e, same)
        out = [(u, None, n) for u, n in counts.items()] + [(u, v, None) for u, v in links]
        return pd.DataFrame({c: pd.array(x, dtype="Int64") for c, x in zip("uvn", zip(*out))} if out else {"u": [], "v": [], "n": []})

    return met.groupBy("a", "b").applyInPandas(run, "u long, v long, n long")


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    v = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    sound = F.coalesce(
        F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) )
        & F.exists(v, lambda c: c != 0), F.lit(False))
    largest = F.array_max(F.transform("v", lambda c: F.abs(c)))
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v"), sound.alias("sound"))
    rows = rows.withColumn("v", F.transform("v", lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c)))
    rows = rows.withColumn("id", F.when(F.col("sound"), F.xxhash64("v")))
    scaled = F.transform("v", lambda c: c / largest)
    unit = F.transform("s", lambda c: c / F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, y: a + y * y)))
    classes = rows.where("sound").groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.first("v").alias("v"))
    classes = classes.withColumn("s", scaled).withColumn("x", unit).withColumn("size", F.size("x"))
    classes = staged(classes.select("id", "n", "first", "x", "size"), "vector_classes")
    found = None
    for r in classes.groupBy("size").agg(F.count(F.lit(1)).alias("c")).orderBy("size").collect():  # one per vector length
        one = _index_one(classes.where(F.col("size") == r["size"]), r["size"], r["c"])
        found = one if found is None else found.unionByName(one)
    spark = vectors.sparkSession
    found = staged(found, "vector_links") if found is not None else spark.createDataFrame([], "u long, v long, n long")
    extra = found.where("n is not null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("extra"))
    joined = connected_components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "id")
    joined = joined.join(classes.select("id", "first"), "id")
    lowest = joined.groupBy("component").agg(F.min("first").alias("lowest"))
    joined = joined.join(lowest, "component").select("id", "lowest")
    info = classes.select("id", "n", "first").join(extra, "id", "left").join(joined, "id", "left").select(
        F.col("id").alias("class_id"), (F.col("n") - 1 + F.coalesce("extra", F.lit(0))).alias("n_links"),
        F.coalesce("lowest", "first").alias("component_id"))
    some = rows.where("sound").select("vec_id", "id").join(info, F.col("id") == F.col("class_id")).select("vec_id", "n_links", "component_id")
    none = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
