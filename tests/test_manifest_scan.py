"""The two scans under the manifests: hot keys, uneven quantities, quantile cuts, plan size."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lotwise import plans as E
from lotwise.operators import scan
from lotwise.operators import schedule as sc
from test_properties import _walk

SF = "/root/testdata/sf0.001"
DAY0 = dt.date(2026, 1, 1)
INVENTORY = "product_id long, lot_id long, lot_number string, expiry_date date, status string, current_qty long"
LINES = "flight_id long, product_id long, dep_ts timestamp_ntz, final_qty long"


def _tables(spark, products):
    """{product: (lots (id, expiry, qty), lines (flight, day, need))} as inventory and lines."""
    inv = [(p, i, f"L{i}", e, "optimal", q) for p, (lots, _) in products.items() for i, e, q in lots]
    lines = [(f, p, dt.datetime.combine(d, dt.time(f % 24, f % 60)), n) for p, (_, ls) in products.items() for f, d, n in ls]
    return spark.createDataFrame(inv, INVENTORY), spark.createDataFrame(lines, LINES)


def _by_clock(lines):
    return sorted(lines, key=lambda x: (x[1], x[0] % 24, x[0] % 60, x[0]))


def _sequential(products):
    want = {}
    for p, (lots, lines) in products.items():
        order = {f: k for k, (f, _, _) in enumerate(_by_clock(lines))}
        back = {k: f for f, k in order.items()}
        walked = _walk(lots, [(order[f], d, n) for f, d, n in lines])
        want |= {(back[f], p, i): q for (f, i), q in walked.items()}
    return want


@pytest.mark.parametrize("cut_rows,cuts", [(4096, 128), (5, 128), (1, 3)])
def test_hot_product_and_uneven_lots(spark, monkeypatch, cut_rows, cuts):
    """One product has most rows, on few days; lots of 1 and of 10^9 units; positions cut at many quantiles."""
    monkeypatch.setattr(scan, "CUT_ROWS", cut_rows)
    monkeypatch.setattr(scan, "MOST_CUTS", cuts)
    rng = random.Random(4)

    def lots(n, first):
        return [(first + i, DAY0 + dt.timedelta(rng.choice([3, 3, 3, 6])), rng.choice([1, 2, 30, 10**9 if i % 40 == 7 else 5])) for i in range(n)]

    def lines(n):
        return [(f, DAY0 + dt.timedelta(rng.randint(0, 5)), rng.choice([0, 1, 7, 40, 3 * 10**8 if f % 50 == 3 else 9])) for f in range(n)]

    products = {1: (lots(400, 0), lines(300)), 2: (lots(3, 1000), lines(5)), 3: ([], lines(4)), 4: (lots(2, 2000), [])}
    inv, need = _tables(spark, products)
    got = {(r.flight_id, r.product_id, r.lot_id): r.taken_qty for r in sc.allocate_flights(need, inv).collect()}
    want = _sequential(products)
    assert got == want
    short = {(r.flight_id, r.product_id): r.shortfall_qty for r in sc.flight_shortfall(need, inv).collect()}
    taken = {}
    for (f, p, _), q in want.items():
        taken[f, p] = taken.get((f, p), 0) + q
    missing = {(f, p): n - taken.get((f, p), 0) for p, (_, ls) in products.items() for f, _, n in ls}
    assert short == {k: v for k, v in missing.items() if v}


def test_rows_do_not_follow_quantities(spark):
    """A lot of 10^9 units makes as many rows as one of 10."""
    counts = []
    for size in (10, 10**9):
        inv, lines = _tables(spark, {1: ([(1, DAY0, size)], [(f, DAY0 - dt.timedelta(1), size // 5) for f in range(5)])})
        counts.append(sc.allocate_flights(lines, inv).count())
        events = sc._scanned(lines, inv, "final_qty")
        assert events.count() == 6
    assert counts == [5, 5]


def test_max_plus_scan_does_not_depend_on_chunks(spark):
    rng = random.Random(8)
    rows = [(k, t, rng.randint(0, 9) * (t % 2), rng.randint(0, 9) * (t % 2 == 0)) for k in range(4) for t in range(60)]
    df = spark.createDataFrame(rows, "k long, t long, need long, stock long")
    found = []
    for width in (1, 7, 1000):
        out = scan.max_plus_scan(df, ["k"], ["t"], F.floor(F.col("t") / width), "need", "stock")
        found.append(sorted(map(tuple, out.select("k", "t", "need_before", "stock_before", "lead", "stock_all").collect())))
    assert found[0] == found[1] == found[2]
    for k in range(4):
        n = x = 0
        lead = None
        for (_, t, need, stock), got in zip([r for r in rows if r[0] == k], [r for r in found[0] if r[0] == k]):
            lead = x - n if lead is None else max(lead, x - n)
            assert got[2:5] == (n, x, lead)
            n, x = n + need, x + stock


def _exchanges(df):
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    return sum(" Exchange " in x or "BroadcastExchange" in x for x in final.split("\n") if "ReusedExchange" not in x)


def test_manifest_plan_is_at_most_half(spark):
    """39 exchanges before the scans."""
    assert _exchanges(E.queries()["flight_manifest_allocation"](spark, SF)) <= 19
