"""Training, category, prediction and gradient views over the given tables.

Every view has a Spark definition and a SQL text of the same rows, so that each
catalog query can be repeated on another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareboost.functions.hashing import HASH_HEX_DIGITS, HASH_SPAN, row_uniform
from rareboost.functions.losses import sigmoid
from rareboost.session import as_staged, spread, stage, still_staged

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice", "o_totalprice"]
N_BINS = 32
MODELS = ("linear", "noisy", "quantity")
SEEDS = (42, 7)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- L: order lines with a rare label -------------------------------------------------

_ROW_ID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {day}, cast(round(l_extendedprice * 100) as bigint))"
)
_Y0 = "l_extendedprice * (1 - l_discount) >= 94000"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with part and order features, segments, time and label ``y``.

    The joins carry numbers only; keys as text and the label are built behind them.
    """
    table = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"
    )
    part = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice",
        F.col("p_brand").alias("seg_brand"), "p_type",
    )
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", F.col("o_orderpriority").alias("seg_priority"), "o_custkey"
    )
    flip = F.substring(F.md5(F.concat_ws("|", "row_id", F.lit("flip"))), 1, 2) == "00"
    joined = spread(table, "l_orderkey", "l_partkey").join(orders, "l_orderkey").join(part, "l_partkey")
    rows = joined.select(
        "l_orderkey", "l_partkey", F.expr(_ROW_ID.format(day="date_format(l_shipdate, 'yyyyMMdd')")).alias("row_id"),
        "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_shipdate").alias("ts"),
        F.expr(_Y0).cast("int").alias("y0"), "p_size", "p_retailprice", "seg_brand", "p_type", "o_totalprice", "seg_priority", "o_custkey",
    )
    return rows.withColumn("y", F.when(flip, 1 - F.col("y0")).otherwise(F.col("y0")))


_STAGED: dict[tuple[str, str], DataFrame] = {}


def staged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, label and features of ``lines``, staged once per session for the queries that read them several times."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STAGED or not still_staged(_STAGED[key]):
        _STAGED[key] = stage(lines(spark, sf_dir).select("row_id", "y", *FEATURES), "zstd")
    return _STAGED[key]


LINES_SQL = f"""lines AS MATERIALIZED (
  SELECT *, CASE WHEN substr(md5(concat_ws('|', row_id, 'flip')), 1, 2) = '00' THEN 1 - y0 ELSE y0 END AS y FROM (
    SELECT {_ROW_ID.format(day="strftime(l_shipdate, '%Y%m%d')")} AS row_id,
      l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate AS ts,
      CAST({_Y0} AS INTEGER) AS y0, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, p_brand AS seg_brand, p_type,
      o_totalprice, o_orderpriority AS seg_priority, o_custkey
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey))"""


def hash_sql(tag: str, seed: int = 42, round_: int = 0, key: str = "row_id") -> str:
    return (
        f"CAST('0x' || substr(md5(concat_ws('|', {key}, '{seed}', '{round_}', '{tag}')), 1, {HASH_HEX_DIGITS}) AS BIGINT)"
    )


def uniform_sql(tag: str, seed: int = 42, round_: int = 0, key: str = "row_id") -> str:
    return f"({hash_sql(tag, seed, round_, key)} / CAST({HASH_SPAN} AS DOUBLE))"


def sigmoid_sql(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-({x}))) ELSE exp({x}) / (1.0::DOUBLE + exp({x})) END)"


# --- G: gradients of a fixed first score ----------------------------------------------

_PRED = "-2.8e0 + 1.5e0 * (l_extendedprice / 100000 - 0.5e0) - 4e0 * l_discount"


def gradients(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """``lines`` (or ``rows`` of them) with a fixed linear score and its cross-entropy gradients to nine decimals."""
    p = sigmoid(F.col("pred"))
    return (
        (lines(spark, sf_dir) if rows is None else rows).withColumn("pred", F.expr(_PRED))
        .withColumns({"g": F.round(p - F.col("y"), 9), "h": F.round(p * (1.0 - p), 9)})
    )


GRADIENTS_SQL = f"""{LINES_SQL},
gradients AS MATERIALIZED (
  SELECT *, round(pr - y, 9) AS g, round(pr * (1 - pr), 9) AS h
  FROM (SELECT *, {sigmoid_sql('pred')} AS pr FROM (SELECT *, {_PRED} AS pred FROM lines)))"""


# --- P: predictions of several models and seeds ---------------------------------------

_SCORE = {
    "linear": "3e0 * z - 5e0",
    "noisy": "2e0 * z - 4e0 + 4e0 * (u - 0.5e0)",
    "quantity": "0.05e0 * l_quantity - 4e0 + 2e0 * (u - 0.5e0)",
}
_Z = "(l_extendedprice * (1 - l_discount) - 60000) / 20000"


def predictions(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """``row_id, y, model, seed, p`` of ``lines`` (or of ``rows`` with their columns): probabilities to two decimals, so ties abound."""
    u = F.array(*[F.struct(F.lit(s).alias("seed"), row_uniform("score", s).alias("u")) for s in SEEDS])
    rows = (lines(spark, sf_dir) if rows is None else rows).select("row_id", "y", "l_quantity", F.expr(_Z).alias("z"), F.inline(u))
    scores = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).alias("x")) for m, e in _SCORE.items()])
    return rows.select("row_id", "y", "seed", F.inline(scores)).select(
        "row_id", "y", "model", "seed", F.round(sigmoid(F.col("x")), 2).alias("p")
    )


def staged_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a view of staged lines, for queries that read them several times; staged themselves they would be six rows a line."""
    scored = stage(lines(spark, sf_dir).select("row_id", "y", "l_quantity", "l_extendedprice", "l_discount"), "zstd")
    return as_staged(predictions(spark, sf_dir, scored))


PREDICTIONS_SQL = f"""{LINES_SQL},
preds AS MATERIALIZED (
  SELECT row_id, y, model, seed, round({sigmoid_sql('x')}, 2) AS p FROM (
""" + " UNION ALL ".join(
    f"SELECT row_id, y, '{m}' AS model, {s} AS seed, {e} AS x "
    f"FROM (SELECT *, {_Z} AS z, {uniform_sql('score', s)} AS u FROM lines)\n"
    for m, e in _SCORE.items() for s in SEEDS
) + "))"


def one_model(spark: SparkSession, sf_dir: str, model: str = "noisy", seed: int = 42) -> DataFrame:
    return predictions(spark, sf_dir).where((F.col("model") == model) & (F.col("seed") == seed)).drop("model", "seed")


ONE_MODEL_SQL = f"{PREDICTIONS_SQL},\nscored AS MATERIALIZED (SELECT row_id, y, p FROM preds WHERE model = 'noisy' AND seed = 42)"


# --- E: events ------------------------------------------------------------------------

_K = "regexp_extract(props, '\"k\": ([0-9]+)', 1)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a key, a segment (user), a time, a category code and a rare label."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), "ts", "user_id", "event_type", "value",
        F.expr(_K).cast("int").alias("k"), (F.col("value") >= 150).cast("int").alias("y"),
    )


EVENTS_SQL = f"""ev AS MATERIALIZED (
  SELECT event_id AS row_id, ts, user_id, event_type, value, CAST({_K} AS INTEGER) AS k,
    CAST(value >= 150 AS INTEGER) AS y FROM events)"""
