"""Property tests: window forms equal their loop / plain-window definitions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lotwise.operators import allocate as al
from lotwise.operators import features as fe
from lotwise.operators import regression as rg
from lotwise.operators.logistics import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from lotwise.operators.windows import running_sum


def _greedy(lots, need):
    """The reference walk: lots by expiry, take min(needed, available) until covered."""
    out = {}
    for lot_id, expiry, qty, status in sorted(lots, key=lambda x: (x[1], x[0])):
        if need <= 0:
            break
        if qty <= 0 or status == "critical":
            continue
        take = min(need, qty)
        out[lot_id] = take
        need -= take
    return out, need


def test_fefo_equals_greedy(spark):
    rng = random.Random(7)
    rows, needs, expected, short = [], [], {}, {}
    lot_id = 0
    base = dt.date(2025, 1, 1)
    for p in range(40):
        lots = []
        for _ in range(rng.randint(0, 6)):
            lot_id += 1
            lots.append((lot_id, base + dt.timedelta(days=rng.randint(0, 5)), rng.randint(-5, 40),
                         rng.choice(["critical", "warning", "optimal", "optimal"])))
        need = rng.randint(0, 120)
        needs.append((p, need))
        got, left = _greedy(lots, need)
        for k, v in got.items():
            expected[(p, k)] = v
        if left > 0:
            short[p] = left
        rows += [(p, l, f"L{l}", e, s, q) for l, e, q, s in lots]
    inv = spark.createDataFrame(
        rows, "product_id long, lot_id long, lot_number string, expiry_date date, status string, current_qty long"
    )
    lines = spark.createDataFrame(needs, "product_id long, final_qty long")
    got = {(r.product_id, r.lot_id): r.taken_qty for r in al.fefo_allocate(lines, inv).collect()}
    assert got == expected
    got_short = {r.product_id: r.shortfall_qty for r in al.shortfall(lines, inv).collect()}
    assert got_short == short
    # sum of takes + shortfall = need
    for p, need in needs:
        assert sum(v for (q, _), v in got.items() if q == p) + got_short.get(p, 0) == need


def test_chunked_running_sum_equals_plain_window(spark):
    rng = random.Random(3)
    # one hot key holding most rows, plus small keys
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 20), rng.randint(0, 30), i, rng.randint(-3, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, id long, v long")
    w = Window.partitionBy("k").orderBy("o", "id")
    plain = df.select("id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                      F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    a = {r.id: (r.before or 0, r.upto) for r in plain.collect()}
    ex = running_sum(df, ["k"], ["o", "id"], "v", "before", F.col("o"), inclusive=False)
    inc = running_sum(df, ["k"], ["o", "id"], "v", "upto", F.col("o"), inclusive=True)
    b = {r.id: r.before for r in ex.collect()}
    c = {r.id: r.upto for r in inc.collect()}
    assert {i: (b[i], c[i]) for i in b} == a


def test_split_exact_counts(spark):
    rows = [(p, p * 1000 + i, float(i)) for p in range(6) for i in range(p * 7 + 3)]
    df = spark.createDataFrame(rows, "product_id long, service_id long, consumed_qty double")
    s = fe.split_flags(df)
    for r in s.groupBy("product_id", "n").agg(F.count_if("is_test").alias("t")).collect():
        assert r.t == int(np.ceil(r.n * 0.2))


def _random_training(rng, keys=5, rows_per_key=(8, 40)):
    cats = {
        "airline": ["A", "B", "C"], "route_type": ["Nacional", "Internacional"], "daypart": ["Mañana", "Tarde", "Noche"],
        "weekday": ["Lunes", "Martes", "Jueves"], "season": ["Baja", "Alta"], "weather": ["Soleado", "Nevado"],
        "origin_locality": ["X", "Y", "Z"], "dest_locality": ["X", "Y"], "category": ["c1"], "special_type": [None, "VIP"],
    }
    rows = []
    sid = 0
    for k in range(keys):
        for _ in range(rng.randint(*rows_per_key)):
            sid += 1
            num = [rng.randint(1, 300), rng.randint(100, 9000), rng.choice([300, 400, 500])]
            cv = [rng.choice(cats[c]) for c in CATEGORICAL_FEATURES]
            y = 0.3 * num[0] + (5 if cv[2] == "Mañana" else 0) + rng.gauss(0, 3) + 10 * k
            rows.append((k, sid, *num, *cv, float(round(y))))
    return rows


def test_gram_solve_matches_lstsq(spark):
    rng = random.Random(11)
    rows = _random_training(rng)
    cols = ["product_id", "service_id", *NUMERIC_FEATURES, *CATEGORICAL_FEATURES, "consumed_qty"]
    schema = ", ".join(
        f"{c} {'long' if c in ('product_id', 'service_id') else 'int' if c in NUMERIC_FEATURES else 'double' if c == 'consumed_qty' else 'string'}"
        for c in cols
    )
    df = spark.createDataFrame(rows, schema)
    counted = df.join(df.groupBy("product_id").count().withColumnRenamed("count", "n_train"), "product_id")
    pred = {r.service_id: r.raw_pred for r in rg.predict(df, rg.fit_models(counted, "n_train"), ["service_id"]).collect()}
    # leaving out key-constant columns (category here) gives the same predictions, and so does
    # cutting every key into blocks of a few rows
    for kw in ({"exclude": ("category",)}, {"block_rows": 7}):
        coefs2 = rg.fit_models(counted, "n_train", **kw)
        pred2 = {r.service_id: r.raw_pred for r in rg.predict(df, coefs2, ["service_id"]).collect()}
        assert max(abs(pred[k] - pred2[k]) for k in pred) < 1e-8, kw
    for k in sorted({r[0] for r in rows}):
        sub = [r for r in rows if r[0] == k]
        levels = sorted({(j, r[5 + j]) for r in sub for j in range(len(CATEGORICAL_FEATURES)) if r[5 + j] is not None})
        X = np.array([[r[2], r[3], r[4]] + [1.0 if r[5 + j] == v else 0.0 for j, v in levels] for r in sub], float)
        y = np.array([r[-1] for r in sub])
        xm, ym = X.mean(0), y.mean()
        beta = np.linalg.lstsq(X - xm, y - ym, rcond=None)[0]
        ref = (X - xm) @ beta + ym
        ours = np.array([pred[r[1]] for r in sub])
        assert np.max(np.abs(ours - ref)) < 1e-4 * max(1.0, np.max(np.abs(ref)))


def test_units_truncate_and_clamp(spark):
    df = spark.createDataFrame([(2.99999999999,), (2.99996,), (2.7,), (-3.2,), (0.00001,)], "raw double")
    got = [r[0] for r in df.select(rg.units("raw")).collect()]
    assert got == [3, 2, 2, 0, 0]


def _levels(n, rare, confounded=False, seed=3):
    """n rows of slots (3 numbers, a level of 4, and a rare level worth 40 units in ``rare`` rows)."""
    g = np.random.default_rng(seed)
    x = np.column_stack([g.integers(1, 300, n), g.integers(100, 9000, n), g.choice([300, 400], n)]).astype(float)
    level = g.integers(10, 14, n)
    special = np.zeros(n, bool)
    special[g.choice(n, rare, replace=False)] = True
    fids = np.column_stack([np.full(n, 1), np.full(n, 2), np.full(n, 3), np.where(special, 20, level)])
    slots = np.column_stack([x, np.ones(n)])
    if confounded:  # a second rare level in exactly the same rows
        fids = np.column_stack([fids, np.full(n, 30)])
        slots = np.column_stack([slots, np.where(special, 1.0, np.nan)])
    y = 0.3 * x[:, 0] + 0.001 * x[:, 1] + 40.0 * special + level
    return fids, slots, y


@pytest.mark.parametrize("n,rare,confounded", [(200, 1, False), (100_000, 1, False), (1_000_000, 1, False), (100_000, 3, True)])
def test_rare_levels_survive_at_any_size(n, rare, confounded):
    """One estimator at every size: rare levels are fitted, as lstsq on the rows does."""
    fids, slots, y = _levels(n, rare, confounded)
    whole = None
    for part in np.array_split(np.arange(n), max(1, n // 50_000)):
        one = rg.block_moments(fids[part], slots[part], y[part])
        whole = one if whole is None else rg.merge_moments(whole, one)
    _, ids, mean, cross, size = whole
    intercept, beta, rank = rg.solve_moments(mean, cross, size)
    special = (fids == 20).any(1)
    rows = np.r_[np.flatnonzero(special), np.arange(min(n, 2000))]
    x = np.zeros((n, len(ids)))
    r, c = np.nonzero(~np.isnan(slots))
    x[r, np.searchsorted(ids, fids[r, c])] = slots[r, c]
    xm = x.mean(0)
    if n <= 100_000:
        ref, _, ref_rank, _ = np.linalg.lstsq(x - xm, y - y.mean(), rcond=1e-13)
        assert rank == ref_rank
        assert np.abs(beta - ref).max() < 1e-6
    got = intercept + x[rows] @ beta
    assert np.abs(got - y[rows]).max() < 30  # the level column is mixed with noise-free parts
    exact = np.linalg.lstsq(np.column_stack([np.ones(n), x]), y, rcond=1e-13)[0]
    assert np.abs(got - np.column_stack([np.ones(len(rows)), x[rows]]) @ exact).max() < 1e-6


def test_fit_models_hot_and_small_keys_match_lstsq(spark):
    """One hot key (600 rows, five blocks) next to small keys."""
    rng = random.Random(17)
    rows = _random_training(rng, keys=1, rows_per_key=(600, 600))
    rows += [(k + 1,) + r[1:] for k, r in enumerate(_random_training(random.Random(2), keys=3, rows_per_key=(15, 30)))]
    # renumber service ids to keep them unique
    rows = [(r[0], i) + r[2:] for i, r in enumerate(rows)]
    cols = ["product_id", "service_id", *NUMERIC_FEATURES, *CATEGORICAL_FEATURES, "consumed_qty"]
    schema = ", ".join(
        f"{c} {'long' if c in ('product_id', 'service_id') else 'int' if c in NUMERIC_FEATURES else 'double' if c == 'consumed_qty' else 'string'}"
        for c in cols
    )
    df = spark.createDataFrame(rows, schema)
    counted = df.join(df.groupBy("product_id").count().withColumnRenamed("count", "n_train"), "product_id")
    coefs = rg.fit_models(counted, "n_train", block_rows=128)
    pred = {r.service_id: r.raw_pred for r in rg.predict(df, coefs, ["service_id"]).collect()}
    for k in sorted({r[0] for r in rows}):
        sub = [r for r in rows if r[0] == k]
        levels = sorted({(j, r[5 + j]) for r in sub for j in range(len(CATEGORICAL_FEATURES)) if r[5 + j] is not None})
        X = np.array([[r[2], r[3], r[4]] + [1.0 if r[5 + j] == v else 0.0 for j, v in levels] for r in sub], float)
        y = np.array([r[-1] for r in sub])
        xm, ym = X.mean(0), y.mean()
        beta = np.linalg.lstsq(X - xm, y - ym, rcond=None)[0]
        ref = (X - xm) @ beta + ym
        ours = np.array([pred[r[1]] for r in sub])
        assert np.max(np.abs(ours - ref)) < 1e-4 * max(1.0, np.max(np.abs(ref))), k


def _walk(lots, lines):
    """Sequential greedy: lines by departure take valid lots by expiry; expired stock is lost."""
    left = {l[0]: l[2] for l in lots}
    out = {}
    for fid, day, need in sorted(lines, key=lambda x: (x[1], x[0])):
        for lid, expiry, _ in sorted(lots, key=lambda x: (x[1], x[0])):
            if expiry <= day:
                left[lid] = 0
            take = min(need, left[lid])
            if take:
                out[fid, lid] = take
                left[lid] -= take
                need -= take
    return out


def test_flight_allocation_equals_sequential_walk(spark):
    """Many flights over lots that expire inside the schedule; one flight equals W1."""
    from lotwise.operators import schedule as sc

    rng = random.Random(9)
    day0 = dt.date(2026, 1, 1)
    inv_rows, line_rows, want = [], [], {}
    for product in range(12):
        lots = [(product * 100 + i, day0 + dt.timedelta(rng.randint(1, 9)), rng.randint(1, 700)) for i in range(rng.randint(0, 7))]
        lines = [(f, day0 + dt.timedelta(rng.randint(0, 9)), rng.randint(1, 600)) for f in range(rng.randint(1, 6))]
        inv_rows += [(product, i, f"L{i}", e, "optimal", q) for i, e, q in lots]
        line_rows += [(f, product, dt.datetime.combine(d, dt.time(8)), n) for f, d, n in lines]
        want |= {(f, product, i): q for (f, i), q in _walk(lots, lines).items()}
    inv = spark.createDataFrame(inv_rows, "product_id long, lot_id long, lot_number string, expiry_date date, status string, current_qty long")
    lines = spark.createDataFrame(line_rows, "flight_id long, product_id long, dep_ts timestamp_ntz, final_qty long")
    got = {(r.flight_id, r.product_id, r.lot_id): r.taken_qty for r in sc.allocate_flights(lines, inv).collect()}
    assert got == want
    short = {(r.flight_id, r.product_id): r.shortfall_qty for r in sc.flight_shortfall(lines, inv).collect()}
    taken = {}
    for (f, p, _), q in want.items():
        taken[f, p] = taken.get((f, p), 0) + q
    assert short == {(f, p): n - taken.get((f, p), 0) for f, p, _, n in line_rows if n > taken.get((f, p), 0)}
    early = lines.where("flight_id = 0").withColumn("dep_ts", F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz"))
    one = {(r.product_id, r.lot_id): r.taken_qty for r in sc.allocate_flights(early, inv).collect()}
    assert one == {(r.product_id, r.lot_id): r.taken_qty for r in al.fefo_allocate(early, inv).collect()}
