"""Sparse one-hot features, the feature vocabulary and the hold-out split.

One-hot encoding stays *long*: each row becomes at most 13 (feature, x) pairs,
so the schema is fixed whatever the vocabulary. Feature names are the column
name for numerics and ``column=value`` for indicators; NULL categories give no
indicator (all zeros), and no level is dropped.

The hold-out split marks exactly ``ceil(0.2 n)`` rows of each key as test rows,
chosen by the order of ``md5(service_id || ':42')``. A key of up to ``HOT_ROWS`` rows is ranked in
place: its rows are dealt by key once, and what follows by key needs no further exchange. A
larger key is not ranked, its last test row is selected: counts per (key, hash prefix) tell which prefix holds the last test row, that one prefix is
put in order to find the row, and every row is then flagged by comparison with it. The
training set is written once and these passes read the columns they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.logistics import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from lotwise.session import materialize
from lotwise.sources.literals import literal_table

CONST = ""  # the all-ones column (intercept)
TARGET = "~y"  # the target, carried through the Gram as one more column
CONST_ID = 0  # 64-bit ids of the two pseudo features
TARGET_ID = -1
TEST_FRACTION = 0.2
SPLIT_SEED = 42
PREFIX_DIGITS = 3
MIN_ROWS = 10
PART_ROWS = 32_768  # rows of a task after they were dealt by key
HOT_ROWS = 50_000  # keys with more rows are split by selection


def feature_name(column: str, value=None):
    if value is None:
        return F.lit(column)
    return F.concat(F.lit(column + "="), value)


def feature_array(
    numeric: list[str] = NUMERIC_FEATURES,
    categorical: list[str] = CATEGORICAL_FEATURES,
    with_const: bool = False,
    target: str | None = None,
):
    """Array<struct<feature, x>> of the non-zero features of a row."""
    items = []
    if with_const:
        items.append(F.struct(F.lit(CONST).alias("feature"), F.lit(1.0).alias("x")))
    for c in numeric:
        items.append(
            F.when(
                F.col(c).isNotNull(),
                F.struct(feature_name(c).alias("feature"), F.col(c).cast("double").alias("x")),
            )
        )
    for c in categorical:
        items.append(
            F.when(
                F.col(c).isNotNull(),
                F.struct(
                    feature_name(c, F.col(c).cast("string")).alias("feature"), F.lit(1.0).alias("x")
                ),
            )
        )
    if target is not None:
        items.append(F.struct(F.lit(TARGET).alias("feature"), F.col(target).cast("double").alias("x")))
    return F.filter(F.array(*items), lambda s: s.isNotNull())


def feature_id(column: str, value=None):
    """64-bit id of a feature: xxhash64(column) for numerics, xxhash64(column, value)
    for indicators. Ids keep group and join keys fixed-width; names are joined
    back only onto small results (the vocabulary maps id -> name)."""
    if value is None:
        return F.xxhash64(F.lit(column))
    return F.xxhash64(F.lit(column), value)


KEY_CONSTANT = ("category", "special_type")  # product attributes: constant per product


def id_items(
    numeric: list[str] = NUMERIC_FEATURES,
    categorical: list[str] = CATEGORICAL_FEATURES,
    with_const: bool = False,
    target: str | None = None,
    exclude: tuple[str, ...] = (),
) -> list:
    """Struct<fid, x> expressions (NULL when the feature is absent).

    ``exclude`` drops columns that are constant within the model key: centred,
    such a column is exactly zero, so its minimum-norm coefficient is 0 and
    leaving it out changes no coefficient or prediction.
    """
    numeric = [c for c in numeric if c not in exclude]
    categorical = [c for c in categorical if c not in exclude]
    items = []
    if with_const:
        items.append(F.struct(F.lit(CONST_ID).cast("long").alias("fid"), F.lit(1.0).alias("x")))
    for c in numeric:
        items.append(
            F.when(F.col(c).isNotNull(), F.struct(feature_id(c).alias("fid"), F.col(c).cast("double").alias("x")))
        )
    for c in categorical:
        v = F.col(c).cast("string")
        items.append(F.when(F.col(c).isNotNull(), F.struct(feature_id(c, v).alias("fid"), F.lit(1.0).alias("x"))))
    if target is not None:
        items.append(
            F.struct(F.lit(TARGET_ID).cast("long").alias("fid"), F.col(target).cast("double").alias("x"))
        )
    return items


def id_names(vocabulary: DataFrame) -> DataFrame:
    """fid -> feature name for the vocabulary plus the two pseudo features."""
    spark = vocabulary.sparkSession
    fid = F.when(F.col("value").isNull(), F.xxhash64(F.col("column_name"))).otherwise(
        F.xxhash64(F.col("column_name"), F.col("value"))
    )
    pseudo = literal_table(spark, [(CONST_ID, CONST), (TARGET_ID, TARGET)], "fid long, feature string")
    return vocabulary.select(fid.alias("fid"), "feature").unionByName(pseudo)


def names_from_values(spark, values: dict[str, DataFrame]) -> DataFrame:
    """fid -> feature name from the possible values of each categorical column.

    ``values`` maps a categorical column to a one-column DataFrame of its
    values (a dimension attribute or a literal domain); numerics and the two
    pseudo features are added. A superset of the training vocabulary is fine:
    it only names ids.
    """
    parts = [
        df.select(F.col(df.columns[0]).cast("string").alias("value"))
        .where(F.col("value").isNotNull())
        .distinct()
        .select(F.lit(col).alias("column_name"), "value")
        for col, df in values.items()
    ]
    numeric = literal_table(
        spark, [(c, None) for c in NUMERIC_FEATURES], "column_name string, value string"
    )
    vocab = numeric
    for p in parts:
        vocab = vocab.unionByName(p)
    vocab = vocab.withColumn(
        "feature",
        F.when(F.col("value").isNull(), F.col("column_name")).otherwise(
            F.concat(F.col("column_name"), F.lit("="), F.col("value"))
        ),
    )
    return id_names(vocab)


def sparse_features(df: DataFrame, keep: list[str], with_const: bool = False) -> DataFrame:
    """M1 (long form): one row per (row, non-zero feature)."""
    return df.select(*keep, F.explode(feature_array(with_const=with_const)).alias("f")).select(
        *keep, "f.feature", "f.x"
    )


def feature_vocabulary(training: DataFrame) -> DataFrame:
    """M1 + M2: ordinal, feature, column_name, value.

    Numerics first (fixed order), then indicators by column order and sorted value.
    The global row_number runs over the distinct vocabulary only (bounded by the
    number of distinct category values, not by the data).
    """
    spark = training.sparkSession
    numeric = literal_table(
        spark,
        [(i + 1, c, c, None) for i, c in enumerate(NUMERIC_FEATURES)],
        "ordinal int, feature string, column_name string, value string",
    )
    pairs = F.array(
        *[
            F.struct(F.lit(i + 1).alias("col_ord"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
            for i, c in enumerate(CATEGORICAL_FEATURES)
        ]
    )
    cats = (
        training.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .where(F.col("value").isNotNull())
        .distinct()
    )
    ranked = cats.select(
        (F.lit(len(NUMERIC_FEATURES)) + F.row_number().over(Window.orderBy("col_ord", "value"))).alias(
            "ordinal"
        ),
        F.concat(F.col("column_name"), F.lit("="), F.col("value")).alias("feature"),
        "column_name",
        "value",
    )
    return numeric.unionByName(ranked)


def split_flags(
    training: DataFrame,
    key: str = "product_id",
    id_col: str = "service_id",
    tie_cols: tuple[str, ...] = ("consumed_qty",),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """W3 + A9: add n (rows of the key), n_test = ceil(0.2 n), is_test.

    Rows are ordered by (hash, id, ``tie_cols``); rows equal on all of these are
    interchangeable for every output, so the choice among them (by a number fixed when the set is
    written) does not matter.
    """
    return split_stored(store_rows(training, key), key, id_col, tie_cols, hot_rows)


def store_rows(training: DataFrame, key: str = "product_id") -> DataFrame:
    """The training set written once, its rows numbered; a row without a key belongs to no split."""
    return materialize(training.where(F.col(key).isNotNull()).withColumn("_row", F.monotonically_increasing_id()), "training")


def split_stored(
    base: DataFrame,
    key: str = "product_id",
    id_col: str = "service_id",
    tie_cols: tuple[str, ...] = ("consumed_qty",),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``split_flags`` of rows written by ``store_rows``."""
    columns = [c for c in base.columns if c != "_row"]
    hot = base.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(key)
    order = ["_h", id_col, *tie_cols, "_row"]
    if hot.isEmpty():
        return _split_by_rank(base, key, id_col, order).select(*columns, "n", "n_test", "is_test")
    hot = F.broadcast(materialize(hot, "hot"))  # at most rows / hot_rows keys
    ranked = _split_by_rank(base.join(hot, key, "left_anti"), key, id_col, order)
    selected = _split_by_selection(base.join(hot, key, "left_semi"), key, id_col, order)
    return ranked.unionByName(selected).select(*columns, "n", "n_test", "is_test")


def _split_hash(id_col: str):
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{SPLIT_SEED}")))


def _n_test():
    return F.ceil(F.col("n").cast("double") * F.lit(TEST_FRACTION)).cast("long")


def _split_by_rank(base: DataFrame, key: str, id_col: str, order: list[str]) -> DataFrame:
    """Keys of bounded size: rows are dealt by key once, hashed there, and put in order key by key."""
    # the number of parts follows the rows, so a task's rows stay as many on larger tables
    parts = max(base.sparkSession.sparkContext.defaultParallelism, -(-base.count() // PART_ROWS))
    rows = base.repartition(parts, key).withColumn("_h", F.unhex(_split_hash(id_col)))
    whole = Window.partitionBy(key)
    return (
        rows.withColumn("_rank", F.row_number().over(whole.orderBy(*order)))
        .withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("n_test", _n_test())
        .withColumn("is_test", F.col("_rank") <= F.col("n_test"))
        .drop("_h", "_rank")
    )


def _split_by_selection(base: DataFrame, key: str, id_col: str, by: list[str]) -> DataFrame:
    """Keys of any size: no task puts a whole key in order."""
    base = base.withColumn("_h", _split_hash(id_col))
    prefix = F.substring("_h", 1, PREFIX_DIGITS)
    counts = base.groupBy(key, prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(key).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = counts.select(
        key, "_prefix", "c", F.sum("c").over(upto).alias("_upto"), F.sum("c").over(Window.partitionBy(key)).alias("n"))
    # the prefix in which the count of test rows is reached, and how many of its rows are test rows
    at = (
        sized.withColumn("n_test", _n_test())
        .where((F.col("_upto") >= F.col("n_test")) & (F.col("_upto") - F.col("c") < F.col("n_test")))
        .select(key, "_prefix", "n", "n_test", (F.col("n_test") - (F.col("_upto") - F.col("c"))).alias("_k"))
    )
    order = F.struct(*by)
    last = (
        base.select(key, prefix.alias("_prefix"), order.alias("_order")).join(at, [key, "_prefix"])
        .withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("_order")))
        .where("_rank = _k").select(key, "n", "n_test", F.col("_order").alias("_last"))
    )
    return (
        base.join(last, key).withColumn("is_test", order <= F.col("_last"))
        .drop("_h", "_last")
    )


def extend_dictionary(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """``known`` (ordinal, feature, column_name, value) and after it the features of ``wanted`` that it lacks.

    Ordinals already given never change. The window runs over new features only (bounded by the vocabulary).
    """
    new = wanted.join(known.select("feature"), "feature", "left_anti")
    last = known.agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("_last")).withColumn("_one", F.lit(1))
    number = (F.col("_last") + F.row_number().over(Window.orderBy("ordinal", "feature"))).cast("int")
    added = new.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one").select(
        number.alias("ordinal"), "feature", "column_name", "value")
    return known.select("ordinal", "feature", "column_name", "value").unionByName(added)


def trainable(counts: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Keys with at least ``min_rows`` rows (HAVING count >= 10)."""
    return counts.where(F.col("n") >= min_rows)
