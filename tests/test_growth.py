"""What keeps the forecasts' traffic and memory in step with the input."""

import glob
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lotwise.operators import features as fe
from lotwise.operators import forecast as fc
from lotwise.operators import regression as rg
from lotwise.plans import q_models as M
from test_training import SCHEMA, _table

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_dealt_as_narrow_lines(spark):
    """No growing dimension is broadcast by an estimate, and no row is dealt after it has its names."""
    plan = _plan(M._requests(spark, SF))
    assert len(re.findall("SortMergeJoin", plan)) >= 3
    for by in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan):
        assert by.split("#")[0] not in ("lot_id", "product_id", "flight_id"), by
    top = plan.split("Exchange hashpartitioning(flight_id")[0]
    assert "origin_locality" in top and top.count("Exchange hashpartitioning(") == 0


def test_split_by_rank_equals_split_by_selection(spark):
    rng = random.Random(4)
    rows = [(1, i, rng.randint(0, 3)) for i in range(700)] + [(2, 5, 1)] * 11 + [(3, 1, 0), (4, None, 2), (4, 7, 2), (None, 1, 1)]
    base = fe.store_rows(spark.createDataFrame(rows, "product_id long, service_id long, consumed_qty int").repartition(3))
    found = [sorted(map(str, fe.split_stored(base, hot_rows=k).collect())) for k in (0, 10, 100, 10_000)]
    assert len(found[0]) == len(rows) - 1 and found[0] == found[1] == found[2] == found[3]


def test_split_deals_rows_once(spark):
    base = fe.store_rows(spark.createDataFrame([(k, i, 1) for k in range(5) for i in range(20)], "product_id long, service_id long, consumed_qty int"))
    train, _ = M._sides_of(fe.split_stored(base))
    sums = train.groupBy("product_id", "consumed_qty").agg(F.count(F.lit(1)))
    assert len(re.findall("Exchange hashpartitioning", _plan(sums))) == 1


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(fe, "PART_ROWS", 3)
    base = fe.store_rows(spark.range(100).select(F.col("id").alias("product_id"), F.col("id").alias("service_id"), F.lit(1).alias("consumed_qty")))
    assert "hashpartitioning(product_id" in (plan := _plan(fe.split_stored(base))) and re.search(r"hashpartitioning\(product_id#\d+L, 34\)", plan), plan


def test_predict_deals_no_structs(spark):
    _, df = _table(spark, 9, (10, 12))
    plan = _plan(rg.predict(df, rg.fit_level_means(df), ["service_id"]))
    assert "ShuffledHashJoin" in plan and "_items" not in plan


def test_flight_demand_is_not_dealt_by_flight(spark):
    _, df = _table(spark, 9, (10, 12))
    plan = _plan(fc.flight_demand(df.withColumn("flight_id", F.lit(1)), rg.fit_level_means(df)))
    assert not re.search(r"hashpartitioning\(flight_id", plan)


def test_manifest_of_forecasts_forecasts_once(spark):
    for name in ("forecast_manifest", "forecast_flight_manifest"):
        plan = _plan(getattr(M, name)(spark, SF))
        assert "model_coefficients" not in plan and "o_totalprice" not in plan, name


def test_moments_of_few_rows_are_stored_as_rows(spark):
    rng = np.random.default_rng(2)
    for n, p in ((3, 8), (8, 8), (20, 8)):
        z = rng.normal(size=(n, p))
        packed = rg.pack_cross(z)
        assert len(packed) == 8 * p * min(n, p)
        assert np.allclose(rg.unpack_cross(packed, p), z.T @ z)
    _, df = _table(spark, 10, (4, 6))
    for row in rg.moment_blocks(df).collect():
        assert len(row.cross) == 8 * row.n * len(row.mean) < 8 * len(row.mean) ** 2


def test_flight_products_parts_follow_the_lines(spark, monkeypatch):
    from lotwise.plans import q_rules as R

    monkeypatch.setattr(R, "FLIGHT_LINES", 100)
    lines = R._t(spark, SF).lot_services.count()
    plan = _plan(R.flight_products(spark, SF))
    assert re.search(rf"hashpartitioning\(flight_id#\d+L?, {-(-lines // 100)}\), REPARTITION_BY_NUM", plan), plan
    assert not re.search(r"hashpartitioning\(flight_id#\d+L?, product_id", plan)


def test_names_are_not_merged_by_feature(spark):
    """A feature is in every product's Gram and model: dealt by feature, the whole result meets in a few tasks."""
    for name in ("ols_gram", "product_models", "model_normal_equations", "model_level_sums"):
        plan = _plan(getattr(M, name)(spark, SF))
        assert not re.search(r"hashpartitioning\((ia|ib|fid)#", plan), name


def test_training_ranks_the_split_and_writes_the_coefficients_once(spark, monkeypatch):
    sides = []
    monkeypatch.setattr(M, "_TRAINED", {})
    monkeypatch.setattr(M, "_sides_of", lambda split, real=M._sides_of: sides.append(_plan(split)) or real(split))
    before = {*glob.glob(f"{M.checkpoint_dir(spark).removeprefix('file:')}/coefficients-*")}
    models = M._saved(spark, SF, "ols")
    assert len(sides) == 1 and "Window" not in sides[0] and "Exchange" not in sides[0]
    assert {*glob.glob(f"{M.checkpoint_dir(spark).removeprefix('file:')}/coefficients-*")} == before
    keys = {r.key for r in models["model_coefficients"].select("key").distinct().collect()}
    assert keys and keys == {r.key for r in models["model_metrics"].collect()}
