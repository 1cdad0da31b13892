"""Registered queries: features, split, Gram, models, R^2, forecast and scenarios."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lotwise.operators import allocate as al
from lotwise.operators import features as fe
from lotwise.operators import forecast as fc
from lotwise.operators import logistics as lg
from lotwise.operators import regression as rg
from lotwise.operators import schedule as sc
from lotwise.plans.oracle import EXTRA
from lotwise.plans.q_inventory import _inventory
from lotwise.plans.q_logistics import _stock, flight_ctes, shortfall_sql
from lotwise.plans.registry import query
from lotwise.session import checkpoint_dir, materialize
from lotwise.sources.driver_tables import tables_for
from lotwise.sources.literals import literal_table
from lotwise.sources.models import load_models, save_metrics, save_models
from lotwise.sources.schemas import DOMAINS

_CATS = lg.CATEGORICAL_FEATURES
_NUMS = lg.NUMERIC_FEATURES


def _sparse_sql(src: str, with_const: bool, target: str | None) -> str:
    parts = []
    if with_const:
        parts.append(f"SELECT service_id, product_id, '' AS feature, CAST(1.0 AS DOUBLE) AS x FROM {src}")
    for c in _NUMS:
        parts.append(
            f"SELECT service_id, product_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM {src} WHERE {c} IS NOT NULL"
        )
    for c in _CATS:
        parts.append(
            f"SELECT service_id, product_id, '{c}=' || {c}, CAST(1.0 AS DOUBLE) FROM {src} WHERE {c} IS NOT NULL"
        )
    if target:
        parts.append(f"SELECT service_id, product_id, '~y', CAST({target} AS DOUBLE) FROM {src}")
    return "\nUNION ALL ".join(parts)


def _pairs_sql(src: str) -> str:
    """Every pair of augmented columns (const, features, y) of each row, named in order."""
    items = [("''", "CAST(1.0 AS DOUBLE)", None)]
    items += [(f"'{c}'", f"CAST({c} AS DOUBLE)", f"{c} IS NOT NULL") for c in _NUMS]
    items += [(f"'{c}=' || {c}", "CAST(1.0 AS DOUBLE)", f"{c} IS NOT NULL") for c in _CATS]
    items += [("'~y'", "CAST(consumed_qty AS DOUBLE)", None)]
    parts = []
    for i, (fi, xi, ci) in enumerate(items):
        for fj, xj, cj in items[i:]:
            conds = [c for c in (ci, cj) if c]
            where = f" WHERE {' AND '.join(conds)}" if conds else ""
            parts.append(
                f"SELECT product_id, least({fi}, {fj}) AS fa, greatest({fi}, {fj}) AS fb, {xi} * {xj} AS xx "
                f"FROM {src}{where}"
            )
    return "\nUNION ALL ".join(parts)


_VOCAB_CAT = "\nUNION ALL ".join(
    f"SELECT {i + 1} AS col_ord, '{c}' AS column_name, {c} AS value FROM training" for i, c in enumerate(_CATS)
)

EXTRA.extend(
    [
        (
            "vocab",
            f"""SELECT 1 AS ordinal, 'passengers' AS feature, 'passengers' AS column_name, CAST(NULL AS VARCHAR) AS value
                UNION ALL SELECT 2, 'distance_km', 'distance_km', NULL
                UNION ALL SELECT 3, 'max_capacity', 'max_capacity', NULL
                UNION ALL SELECT CAST(3 + row_number() OVER (ORDER BY col_ord, value) AS INTEGER),
                                 column_name || '=' || value, column_name, value
                FROM (SELECT DISTINCT col_ord, column_name, value FROM ({_VOCAB_CAT}) WHERE value IS NOT NULL)""",
        ),
        (
            "split",
            """SELECT t.*, c.n, CAST(ceil(CAST(c.n AS DOUBLE) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS n_test,
                      row_number() OVER (PARTITION BY t.product_id
                                         ORDER BY md5(CAST(t.service_id AS VARCHAR) || ':42'), t.service_id,
                                                  t.consumed_qty) AS rk
               FROM training t JOIN (SELECT product_id, COUNT(*) AS n FROM training GROUP BY product_id) c
                 ON t.product_id = c.product_id""",
        ),
        ("train_rows", "SELECT * FROM split WHERE n >= 10 AND rk > n_test"),
        ("gram_pairs", _pairs_sql("train_rows")),
        (
            "open_requests",
            """SELECT s.service_id, s.flight_id, l.product_id, k.product_name, f.passengers, f.distance_km,
                      a.max_capacity, f.airline, f.route_type, f.daypart, f.weekday, f.season, f.weather,
                      f.origin_locality, f.dest_locality, k.category, k.special_type
               FROM lot_services s JOIN flight_dims f ON s.flight_id = f.flight_id
                                   JOIN aircraft_types a ON f.aircraft_type_id = a.aircraft_type_id
                                   JOIN lots l ON s.lot_id = l.lot_id
                                   JOIN catalog k ON l.product_id = k.product_id
               WHERE s.consumed_qty IS NULL""",
        ),
    ]
)


_FREE = [c for c in _CATS if c not in fe.KEY_CONSTANT]


def _score_sql(rows: str, shown: str) -> str:
    """Lines scored by the mean of the one-way means of their product's training rows."""
    joins = "\n".join(
        f"LEFT JOIN level_means l{i} ON r.product_id = l{i}.product_id AND l{i}.column_name = '{c}' AND r.{c} = l{i}.value"
        for i, c in enumerate(_FREE))
    raw = " + ".join(["b.m", *[f"COALESCE(l{i}.coef, 0.0)" for i in range(len(_FREE))]])
    return f"SELECT {shown}, r.product_id, {raw} AS raw FROM {rows} r JOIN product_means b ON r.product_id = b.product_id\n{joins}"


EXTRA.extend(
    [
        (
            "product_means",
            "SELECT product_id, CAST(SUM(consumed_qty) AS DOUBLE) / COUNT(*) AS m FROM train_rows GROUP BY product_id",
        ),
        (
            "level_means",
            "\nUNION ALL ".join(
                f"""SELECT t.product_id, '{c}' AS column_name, t.{c} AS value,
                           (CAST(SUM(t.consumed_qty) AS DOUBLE) / COUNT(*) - ANY_VALUE(b.m)) / CAST({len(_FREE)} AS DOUBLE) AS coef
                    FROM train_rows t JOIN product_means b ON t.product_id = b.product_id
                    WHERE t.{c} IS NOT NULL GROUP BY t.product_id, t.{c}"""
                for c in _FREE),
        ),
        ("request_scores", _score_sql("open_requests", "r.service_id, r.flight_id")),
        ("test_scores", _score_sql("(SELECT * FROM split WHERE n >= 10 AND rk <= n_test)", "CAST(r.consumed_qty AS DOUBLE) AS y")),
        *flight_ctes(
            "forecast_",
            "SELECT DISTINCT flight_id, product_id, CAST(GREATEST(0, trunc(round(raw, 9))) AS BIGINT) AS base_qty FROM request_scores"),
    ]
)


def _t(spark, sf):
    return tables_for(spark, sf)


def _training(spark, sf):
    t = _t(spark, sf)
    return lg.training_set(
        t.flights, t.airlines, t.aircraft_types, t.airports, t.lot_services, t.lots, t.products, t.categories
    )


def _requests(spark, sf):
    t = _t(spark, sf)
    return lg.open_requests(
        t.flights, t.airlines, t.aircraft_types, t.airports, t.lot_services, t.lots, t.products, t.categories
    )


def _split(spark, sf):
    return fe.split_stored(_stored(spark, sf))


def _stored(spark, sf):
    return fe.store_rows(_training(spark, sf).drop("product_name"))


def _sides(spark, sf):
    """Training and test rows of the trainable products, from one written training set."""
    return _sides_of(_split(spark, sf))


def _sides_of(split):
    rows = split.where(F.col("n") >= fe.MIN_ROWS)
    train = rows.where(~F.col("is_test")).withColumn("n_train", F.col("n") - F.col("n_test"))
    return train, rows.where("is_test")


def _train_rows(spark, sf):
    return _sides(spark, sf)[0]


def _fit(train):
    # Models are keyed by product: its attributes are constant per key and left out.
    return rg.fit_models(train, "n_train", exclude=fe.KEY_CONSTANT)


def _coefs(spark, sf):
    return _fit(_train_rows(spark, sf))


_TRAINED: dict[tuple[str, str, str], str] = {}


def _saved(spark, sf, kind):
    """The saved model of these tables: trained and published once a session, then loaded by schema.

    ``kind`` is ``ols`` or ``means`` (``regression.fit_level_means``).
    """
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _TRAINED:
        rows = _stored(spark, sf)
        # both sides and their passes read the split, so its rows are dealt by product and ranked once
        train, test = _sides_of(materialize(fe.split_stored(rows), "split"))
        vocabulary = materialize(fe.feature_vocabulary(rows), "vocabulary")
        names = fe.id_names(vocabulary)
        coefs = _fit(train) if kind == "ols" else rg.fit_level_means(train, exclude=fe.KEY_CONSTANT)
        path = f"{checkpoint_dir(spark)}/models-{kind}-{uuid.uuid4().hex}"
        # the coefficients are written once: the metrics come from the stored ones
        save_models(path, rg.name_coefficients(coefs, names), vocabulary)
        save_metrics(path, rg.r2_by_key(_scored(test, load_models(spark, path)["model_coefficients"])))
        _TRAINED[key] = path
    return load_models(spark, _TRAINED[key])


def _scored(test, coefs):
    return rg.predict(test, coefs, ["service_id", "consumed_qty"]).withColumnRenamed("consumed_qty", "y")


def _names(spark, sf):
    """Feature names from the dimensions and closed domains (no fact scan)."""
    t = _t(spark, sf)
    loc = t.airports.select("locality")
    values = {
        "airline": t.airlines.select("name"),
        "origin_locality": loc,
        "dest_locality": loc,
        "category": t.categories.select("name"),
        "special_type": t.products.select("special_type"),
    }
    for col, dom in DOMAINS.items():
        values[col] = literal_table(spark, [(v,) for v in dom], "value string")
    values["weather"] = t.flights.select("weather")  # stored freely: may lie outside its domain
    return fe.names_from_values(spark, values)


@query(
    "feature_vocabulary",
    "SELECT ordinal, feature, column_name, value FROM vocab",
    ids="M1 M2",
)
def feature_vocabulary(spark, sf):
    return fe.feature_vocabulary(_training(spark, sf))


@query(
    "training_products",
    "SELECT DISTINCT product_name FROM training",
    ids="A8",
)
def training_products(spark, sf):
    return _training(spark, sf).select("product_name").distinct()


@query(
    "trainable_products",
    "SELECT product_id, COUNT(*) AS n FROM training GROUP BY product_id HAVING COUNT(*) >= 10",
    ids="A9",
)
def trainable_products(spark, sf):
    counts = _training(spark, sf).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    return fe.trainable(counts)


@query(
    "train_test_split_counts",
    """SELECT product_id, n, n_test, COUNT(*) FILTER (WHERE rk <= n_test) AS test_rows,
              COUNT(*) FILTER (WHERE rk > n_test) AS train_rows,
              CAST(SUM(CASE WHEN rk <= n_test THEN service_id ELSE 0 END) AS BIGINT) AS test_id_sum
       FROM split WHERE n >= 10 GROUP BY product_id, n, n_test""",
    ids="W3",
)
def train_test_split_counts(spark, sf):
    s = _split(spark, sf).where(F.col("n") >= fe.MIN_ROWS)
    return s.groupBy("product_id", "n", "n_test").agg(
        F.count_if(F.col("is_test")).alias("test_rows"),
        F.count_if(~F.col("is_test")).alias("train_rows"),
        F.sum(F.when(F.col("is_test"), F.col("service_id")).otherwise(F.lit(0))).cast("long").alias(
            "test_id_sum"
        ),
    )


@query(
    "ols_gram",
    """SELECT product_id AS key, fa, fb, round(SUM(xx), 6) AS s FROM gram_pairs
       WHERE fa IS NOT NULL AND fb IS NOT NULL GROUP BY product_id, fa, fb""",
    ids="M3",
)
def ols_gram(spark, sf):
    g = rg.gram_named(rg.ols_gram(_train_rows(spark, sf)), _names(spark, sf))
    return g.select("key", "fa", "fb", F.round("s", 6).alias("s"))


@query("product_models", None, ids="M3 S7")
def product_models(spark, sf):
    return rg.name_coefficients(_coefs(spark, sf), _names(spark, sf))


NORMAL_EQUATIONS = f"""SELECT DISTINCT product_id, feature, CAST(0.0 AS DOUBLE) AS gradient
        FROM ({_sparse_sql('train_rows', True, None)})"""


@query("model_normal_equations", NORMAL_EQUATIONS, ids="M3 M5")
def model_normal_equations(spark, sf):
    """Sum of x * (y - prediction) per product and feature over the training rows, relative to the
    sizes of x and y: 0 for every feature if and only if the model is a least-squares solution."""
    rows = _train_rows(spark, sf)
    return _gradients(rows, _fit(rows), _names(spark, sf))


def _gradients(rows, coefs, names):
    x = F.explode(F.filter(F.array(*fe.id_items(with_const=True)), lambda i: i.isNotNull())).alias("i")
    scored = rg.predict(rows, coefs, ["consumed_qty", *_NUMS, *_CATS])
    y = F.col("consumed_qty").cast("double")
    sums = (
        scored.select("key", y.alias("y"), (y - F.col("raw_pred")).alias("e"), x)
        .groupBy("key", F.col("i.fid").alias("fid"))
        .agg(F.sum(F.col("i.x") * F.col("e")).alias("g"), F.sum(F.pow("i.x", F.lit(2))).alias("xx"), F.sum(F.pow("y", F.lit(2))).alias("yy"))
    )
    gradient = F.round(F.col("g") / F.sqrt(F.col("xx") * F.col("yy") + 1), 6) + F.lit(0.0)
    return sums.join(F.broadcast(names), "fid").select(F.col("key").alias("product_id"), "feature", gradient.alias("gradient"))


@query("retrained_normal_equations", NORMAL_EQUATIONS, ids="M3")
def retrained_normal_equations(spark, sf):
    """The same, for models of a moment store that was filled in two runs: a first part of the training lines,
    then the rest, whose run reads no line of the first."""
    rows = _train_rows(spark, sf)
    path = f"{checkpoint_dir(spark)}/moments-{uuid.uuid4().hex}"
    first = F.pmod(F.xxhash64("service_id"), F.lit(3)) == 0
    rg.retrain(path, rows.where(first), exclude=fe.KEY_CONSTANT)
    return _gradients(rows, rg.retrain(path, rows.where(~first), exclude=fe.KEY_CONSTANT), _names(spark, sf))


@query(
    "model_level_sums",
    "\nUNION ALL ".join(
        f"SELECT product_id, '{c}' AS column_name, CAST(0.0 AS DOUBLE) AS level_sum FROM train_rows "
        f"GROUP BY product_id HAVING COUNT({c}) = COUNT(*)"
        for c in _FREE
    ),
    ids="M3 S7",
)
def model_level_sums(spark, sf):
    """Sum of the coefficients of a column's levels, per product and column without NULLs: 0 in the
    minimum-norm solution."""
    rows = _train_rows(spark, sf)
    full = rows.groupBy("product_id").agg(*[(F.count(c) == F.count(F.lit(1))).alias(c) for c in _FREE])
    full = full.select("product_id", F.explode(F.array(*[F.when(F.col(c), F.lit(c)) for c in _FREE])).alias("column_name"))
    named = rg.name_coefficients(_fit(rows), _names(spark, sf)).where("fid <> 0")
    named = named.select(F.col("key").alias("product_id"), F.substring_index("feature", "=", 1).alias("column_name"), "coef")
    sums = named.groupBy("product_id", "column_name").agg(
        (F.round(F.sum("coef") / (1 + F.max(F.abs("coef"))), 6) + F.lit(0.0)).alias("level_sum"))
    return full.where("column_name is not null").join(sums, ["product_id", "column_name"])


@query("product_model_r2", None, ids="M4")
def product_model_r2(spark, sf):
    train, test = _sides(spark, sf)
    return rg.r2_by_key(_scored(test, _fit(train))).withColumnRenamed("key", "product_id")


@query(
    "level_mean_r2",
    """SELECT product_id, COUNT(*) AS n_test,
              round(CASE WHEN min(y) = max(y) THEN CASE WHEN sum((y - raw) * (y - raw)) <= count(*) * pow(1e-9 * greatest(1.0, abs(max(y))), 2)
                                                   THEN 1.0 ELSE 0.0 END
                         ELSE 1.0 - sum((y - raw) * (y - raw)) / (var_pop(y) * count(*)) END, 6) AS r2
       FROM test_scores GROUP BY product_id""",
    ids="M4",
)
def level_mean_r2(spark, sf):
    """R² on the held-out lines, read from a saved model: the metrics table of its version."""
    metrics = _saved(spark, sf, "means")["model_metrics"]
    return metrics.select(F.col("key").alias("product_id"), "n_test", F.round("r2", 6).alias("r2"))


@query(
    "score_features_aligned",
    f"""SELECT s.service_id, v.ordinal, s.x
        FROM ({_sparse_sql('open_requests', False, None)}) s JOIN vocab v ON s.feature = v.feature""",
    ids="P15",
)
def score_features_aligned(spark, sf):
    """Request features at the ordinals of the saved model's feature list; unknown ones are left out."""
    return fc.aligned_features(_requests(spark, sf), _saved(spark, sf, "means")["feature_list"], ["service_id"])


@query(
    "saved_model_scores",
    "SELECT service_id, flight_id, product_id, round(raw, 6) AS raw_pred FROM request_scores",
    ids="S7 S8 P15 M5",
)
def saved_model_scores(spark, sf):
    """Every planned line scored by a model that was trained, published, and loaded by schema."""
    coefs = fc.listed(_saved(spark, sf, "means"))
    scored = rg.predict(_requests(spark, sf), coefs, ["service_id", "flight_id"])
    return scored.select("service_id", "flight_id", F.col("key").alias("product_id"), F.round("raw_pred", 6).alias("raw_pred"))


@query("forecast_demand", None, ids="M5 J8 F12 P11 J7")
def forecast_demand(spark, sf):
    return fc.forecast_demand(_requests(spark, sf), fc.listed(_saved(spark, sf, "ols")))


@query("forecast_manifest", None, ids="B6")
def forecast_manifest(spark, sf):
    t = _t(spark, sf)
    forecast = fc.forecast_demand(_requests(spark, sf), fc.listed(_saved(spark, sf, "ols")))
    # read three times: as lines, by the stock that concerns them and by the walk
    lines = materialize(al.manifest_lines(fc.demand_per_product(forecast, t.products), ordered=False), "lines")
    return al.lines_with_assignments(lines, al.fefo_allocate(lines, _inventory(spark, sf)))


def forecast_lines(spark, sf, kind):
    """What a saved model expects on each flight, with the 5 % buffer."""
    t = _t(spark, sf)
    demand = fc.flight_demand(_requests(spark, sf), fc.listed(_saved(spark, sf, kind)))
    return sc.departing_lines(demand, t.products, t.flights)


@query(
    "forecast_flight_lines",
    "SELECT flight_id, product_id, product_name, base_qty, buffer_qty, final_qty FROM forecast_flight_lines",
    ids="B5 B6 M5",
)
def forecast_flight_lines(spark, sf):
    return forecast_lines(spark, sf, "means").drop("dep_ts")


@query("forecast_flight_allocation", "SELECT * FROM forecast_flight_takes", ids="B6 W1")
def forecast_flight_allocation(spark, sf):
    return sc.allocate_flights(forecast_lines(spark, sf, "means"), _stock(spark, sf))


@query("forecast_flight_shortfall", shortfall_sql("forecast_"), ids="B6 W2")
def forecast_flight_shortfall(spark, sf):
    return sc.flight_shortfall(forecast_lines(spark, sf, "means"), _stock(spark, sf))


@query("forecast_flight_manifest", None, ids="B6 W1 W2")
def forecast_flight_manifest(spark, sf):
    """The lots of every flight's predicted load under the least-squares models; a line without lots has NULLs."""
    lines = materialize(forecast_lines(spark, sf, "ols"), "lines")  # forecast once, read as lines and by the queue
    return lines.join(sc.allocate_flights(lines, _stock(spark, sf)), ["flight_id", "product_id"], "left")


@query(
    "scenario_check",
    """SELECT scenario_id, failed_checks FROM (
         SELECT scenario_id, concat_ws(',',
           CASE WHEN passengers IS NULL OR passengers < 1 OR passengers > 500 THEN 'passengers_range' END,
           CASE WHEN distance_km IS NULL OR distance_km < 100 OR distance_km > 20000 THEN 'distance_km_range' END,
           CASE WHEN max_capacity IS NULL OR max_capacity < 50 OR max_capacity > 500 THEN 'max_capacity_range' END,
           CASE WHEN route_type IS NULL OR route_type NOT IN ('Nacional', 'Internacional') THEN 'route_type_domain' END,
           CASE WHEN daypart IS NULL OR daypart NOT IN ('Mañana', 'Tarde', 'Noche') THEN 'daypart_domain' END,
           CASE WHEN weekday IS NULL OR weekday NOT IN ('Lunes', 'Martes', 'Miércoles', 'Jueves', 'Viernes', 'Sábado', 'Domingo') THEN 'weekday_domain' END,
           CASE WHEN season IS NULL OR season NOT IN ('Baja', 'Media', 'Alta') THEN 'season_domain' END,
           CASE WHEN weather IS NULL OR weather NOT IN ('Soleado', 'Lluvioso', 'Nevado', 'Nublado', 'Tormenta') THEN 'weather_domain' END
         ) AS failed_checks
         FROM (SELECT DISTINCT flight_id AS scenario_id, passengers, distance_km, max_capacity, route_type,
                      daypart, weekday, season, weather FROM open_requests))
       WHERE failed_checks <> ''""",
    ids="M6",
)
def scenario_check(spark, sf):
    return fc.scenario_check(fc.scenarios(_requests(spark, sf)))
