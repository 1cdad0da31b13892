"""Hold-out split by selection, mergeable training moments, centred hold-out quality, one demand per flight."""

import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import features as fe
from lotwise.operators import forecast as fc
from lotwise.operators import regression as rg
from lotwise.sources.versions import publish, read_version
from test_properties import _random_training
from lotwise.operators.logistics import CATEGORICAL_FEATURES, NUMERIC_FEATURES

COLS = ["product_id", "service_id", *NUMERIC_FEATURES, *CATEGORICAL_FEATURES, "consumed_qty"]
SCHEMA = ", ".join(
    f"{c} {'long' if c in ('product_id', 'service_id') else 'int' if c in NUMERIC_FEATURES else 'double' if c == 'consumed_qty' else 'string'}"
    for c in COLS)


@pytest.mark.parametrize("parts", [1, 6])
def test_split_selects_exactly_a_fifth(spark, parts):
    """Repeated rows, repeated ids, a null id and a hot product; the same rows as a full sort by hash."""
    rng = random.Random(3)
    rows = [(1, i, rng.randint(0, 3)) for i in range(700)] + [(2, 5, 1)] * 11 + [(3, 1, 0), (4, None, 2), (4, 7, 2)]
    rows += [(1, 10, 9)] * 5
    df = spark.createDataFrame(rows, "product_id long, service_id long, consumed_qty int").repartition(parts)
    got = fe.split_flags(df).withColumn("h", F.md5(F.concat(F.coalesce(F.col("service_id").cast("string"), F.lit("")), F.lit(":42"))))
    assert got.count() == len(rows)
    by = {}
    for r in got.collect():
        by.setdefault(r.product_id, []).append(r)
    for product, found in by.items():
        n = sum(r[0] == product for r in rows)
        k = math.ceil(0.2 * n)
        assert {(r.n, r.n_test) for r in found} == {(n, k)}
        order = sorted((r.h, r.service_id or -1, r.consumed_qty) for r in found)
        assert sorted((r.h, r.service_id or -1, r.consumed_qty) for r in found if r.is_test) == order[:k]


def _table(spark, seed, sizes):
    rows = _random_training(random.Random(seed), keys=3, rows_per_key=sizes)
    return rows, spark.createDataFrame([(r[0], i) + r[2:] for i, r in enumerate(rows)], SCHEMA)


def _predictions(df, coefs):
    return {r.service_id: r.raw_pred for r in rg.predict(df, coefs, ["service_id"]).collect()}


def test_retraining_equals_a_full_fit(spark):
    """Three runs, each adding blocks; then compacted; all equal to a fit on the union (and to lstsq's residuals)."""
    rows, df = _table(spark, 5, (60, 300))
    path = tempfile.mkdtemp(prefix="lotwise-moments-")
    third = F.pmod(F.xxhash64("service_id"), F.lit(3))
    for k in range(3):
        coefs = rg.retrain(path, df.where(third == k), block_rows=40)
    counted = df.join(df.groupBy("product_id").count().withColumnRenamed("count", "n_train"), "product_id")
    want = _predictions(df, rg.fit_models(counted, "n_train"))
    got = _predictions(df, coefs)
    size = max(1.0, *map(abs, want.values()))
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6 * size
    assert {(r.key, r.n_train) for r in coefs.select("key", "n_train").distinct().collect()} == {
        (k, sum(r[0] == k for r in rows)) for k in {r[0] for r in rows}}
    publish(path, replace={"moments": rg.compact(read_version(spark, path, "moments", rg.MOMENTS))})
    small = read_version(spark, path, "moments", rg.MOMENTS)
    assert small.count() == 3
    again = _predictions(df, rg.solve_blocks(small))
    assert max(abs(again[i] - want[i]) for i in want) < 1e-6 * size


def test_a_new_product_and_no_new_lines(spark):
    _, df = _table(spark, 6, (30, 50))
    path = tempfile.mkdtemp(prefix="lotwise-moments-")
    rg.retrain(path, df.where("product_id = 0"))
    both = rg.retrain(path, df.where("product_id = 1"))
    assert {r.key for r in both.select("key").distinct().collect()} == {0, 1}
    same = rg.retrain(path, df.limit(0))
    assert same.select("key").distinct().count() == 2


def test_r2_of_large_targets(spark):
    """Targets of 10^9 +- 1: sums of squares would lose everything."""
    rng = np.random.default_rng(1)
    rows = []
    for key, base in ((1, 1e9), (2, 0.0), (3, -4e9)):
        y = base + rng.integers(-1, 2, 500)
        p = y + rng.normal(0, 0.3, 500)
        rows += [(key, float(a), float(b)) for a, b in zip(y, p)]
    rows += [(4, 1e9, 1e9)] * 9 + [(5, 1e9, 1e9 + 100)] * 9
    got = {r.key: (r.n_test, r.r2) for r in rg.r2_by_key(spark.createDataFrame(rows, "key long, y double, raw_pred double").repartition(5)).collect()}
    for key in (1, 2, 3):
        y, p = (np.array([r[i] for r in rows if r[0] == key]) for i in (1, 2))
        assert got[key] == (500, pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-6))
    assert got[4] == (9, 1.0) and got[5] == (9, 0.0)


def test_level_means_by_hand(spark):
    rows, df = _table(spark, 7, (12, 40))
    got = _predictions(df, rg.fit_level_means(df))
    for r in rows:
        mine = [x for x in rows if x[0] == r[0]]
        mean = sum(x[-1] for x in mine) / len(mine)
        one_way = []
        for j in range(len(CATEGORICAL_FEATURES)):
            same = [x[-1] for x in mine if x[5 + j] == r[5 + j]] if r[5 + j] is not None else []
            one_way.append(sum(same) / len(same) if same else mean)
        r_pred = got[rows.index(r)]
        assert r_pred == pytest.approx(sum(one_way) / len(one_way))


def test_one_demand_per_flight_and_product(spark):
    _, df = _table(spark, 8, (20, 30))
    coefs = rg.fit_level_means(df)
    one = df.where("product_id = 0").limit(1)
    requests = one.withColumn("flight_id", F.lit(1)).unionByName(one.withColumn("flight_id", F.lit(1))).unionByName(one.withColumn("flight_id", F.lit(2)))
    found = fc.flight_demand(requests, coefs).collect()
    assert sorted((r.flight_id, r.product_id) for r in found) == [(1, 0), (2, 0)] and len({r.base_qty for r in found}) == 1
