"""Sources, projections, lookups, binning and encodings."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareboost.functions.hashing import row_uniform
from rareboost.functions.losses import class_prior, init_score
from rareboost.operators import encoding
from rareboost.operators.binning import column_subset_cells, cut_points, distinct_values, fit_binner
from rareboost.operators.folds import shuffled_folds, stratified_folds
from rareboost.plans.fixtures import (
    EVENTS_SQL, FEATURES, LINES_SQL, N_BINS, events, hash_sql, lines, staged_lines, uniform_sql,
)
from rareboost.plans.oracles import bins_sql, folds_sql, stack_sql
from rareboost.plans.registry import query
from rareboost.session import as_staged, ensure_checkpoint_dir, stage
from rareboost.sources import tables

_COLS = ", ".join(FEATURES)


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _rounded_sql(cols, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in cols)


# --- sources and sinks ----------------------------------------------------------------


@query("s1_labelled_csv", f"WITH {LINES_SQL} SELECT {_rounded_sql([*FEATURES, 'y'])} FROM lines")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "labelled")
    tables.write_features(lines(spark, sf_dir), path, FEATURES, "y")
    return tables.read_labelled_csv(spark, path, FEATURES)


@query("s2_features_csv", f"WITH {LINES_SQL} SELECT {_rounded_sql(FEATURES)} FROM lines")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "features")
    tables.write_features(lines(spark, sf_dir), path, FEATURES)
    return tables.read_features_csv(spark, path, FEATURES)


@query("s3_labelled_table", f"WITH {LINES_SQL} SELECT row_id, CAST(y AS DOUBLE) AS y, {_COLS} FROM lines")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.labelled_table(staged_lines(spark, sf_dir), FEATURES)


@query("s4_attach_segments", f"""WITH {LINES_SQL},
side AS (SELECT row_id, seg_brand, CAST(epoch(ts) AS BIGINT) AS unix_ts FROM lines WHERE l_quantity > 10)
SELECT l.row_id, s.seg_brand, s.unix_ts FROM lines l LEFT JOIN side s USING (row_id)""")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = lines(spark, sf_dir)
    unix = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").cast("long")
    side = base.where("l_quantity > 10").select("row_id", "seg_brand", unix.alias("unix_ts"))
    return tables.attach(base.select("row_id"), side, ["seg_brand", "unix_ts"])


@query("s8_feature_sink", f"""WITH {LINES_SQL}
SELECT row_id, y, {', '.join(f'round(ln(1e0 + {f}), 6) AS {f}' for f in FEATURES)} FROM lines""")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "feature-table")
    logs = lines(spark, sf_dir).withColumns({f: F.log(1.0 + F.col(f)) for f in FEATURES})
    tables.rounded(logs, FEATURES).select("row_id", "y", *FEATURES).write.parquet(path)
    return spark.read.parquet(path)


# --- projections and filters ----------------------------------------------------------


@query("p1_subset", f"""WITH {LINES_SQL}
SELECT row_id, y, {_COLS} FROM lines WHERE row_id IN (SELECT row_id FROM lines WHERE seg_priority = '1-URGENT')""")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = lines(spark, sf_dir)
    return tables.subset(base.select("row_id", "y", *FEATURES), base.where("seg_priority = '1-URGENT'"))


_NAMED = ", ".join(f"({i}, '{f}')" for i, f in enumerate(FEATURES))


@query("p2_column_subset", f"""WITH {LINES_SQL}, {bins_sql('lines')},
kept AS (SELECT feature FROM (VALUES {_NAMED}) t(feature, name) ORDER BY md5(concat_ws('|', name, '42', '3', 'column')) LIMIT 5)
SELECT feature, bin, CAST(count(*) AS BIGINT) AS cnt FROM (
  {' UNION ALL '.join(f'SELECT {i} AS feature, b{i} AS bin FROM binned' for i in range(len(FEATURES)))})
WHERE feature IN (SELECT feature FROM kept) GROUP BY feature, bin""")
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = staged_lines(spark, sf_dir)
    coded = base.select(fit_binner(base, FEATURES, N_BINS).codes().alias("codes"))
    return column_subset_cells(coded, FEATURES, rate=0.65, seed=42, round_=3)


_MISSING = {"l_tax": "CASE WHEN l_quantity < 3 THEN CAST('NaN' AS DOUBLE) ELSE l_tax END",
            "l_discount": "CASE WHEN l_quantity < 2 THEN CAST('Infinity' AS DOUBLE) WHEN l_quantity < 4 THEN NULL ELSE l_discount END"}


@query("p3_distinct_finite", f"""WITH {LINES_SQL}, v AS (
  SELECT DISTINCT 0 AS feature, {_MISSING['l_tax']} AS value FROM lines UNION ALL
  SELECT DISTINCT 1 AS feature, {_MISSING['l_discount']} AS value FROM lines UNION ALL
  SELECT DISTINCT 2 AS feature, o_totalprice AS value FROM lines)
SELECT feature, value FROM v WHERE value IS NOT NULL AND isfinite(value)""")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = lines(spark, sf_dir).select(*[F.expr(e).alias(c) for c, e in _MISSING.items()], "o_totalprice")
    return distinct_values(holes, ["l_tax", "l_discount", "o_totalprice"])


@query("p4_class_prior", f"""WITH {LINES_SQL}
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (y > 0.5) AS BIGINT) AS n_pos,
  round(count(*) FILTER (y > 0.5) / CAST(count(*) AS DOUBLE), 9) AS prior FROM lines""")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_prior(lines(spark, sf_dir)).withColumn("prior", F.round("prior", 9))


@query("p5_held_out", f"WITH {LINES_SQL}, {folds_sql('lines', 5)} SELECT row_id, y, fold = 2 AS held_out FROM folded")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = stratified_folds(staged_lines(spark, sf_dir), 5)
    held, rest = folded.where(F.col("fold") == 2), folded.where(F.col("fold") != 2)
    mark = lambda df, flag: df.select("row_id", "y", F.lit(flag).alias("held_out"))
    return mark(held, True).unionAll(mark(rest, False))


@query("o7_init_score", f"""WITH {LINES_SQL}
SELECT round(ln(p / (1 - p)), 6) AS init_score FROM (SELECT avg(CAST(y > 0.5 AS INTEGER)) AS p FROM lines)""")
def o7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_prior(lines(spark, sf_dir)).select(F.round(init_score(F.col("prior")), 6).alias("init_score"))


# --- category encodings and their lookups ---------------------------------------------

_TEST = f"{uniform_sql('split')} < 0.2e0"


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and other rows by row hash (80 / 20)."""
    u = row_uniform("split")
    return df.where(u >= 0.2), df.where(u < 0.2)


_SPLIT_SQL = f"""{LINES_SQL},
train AS MATERIALIZED (SELECT * FROM lines WHERE NOT ({_TEST})), test AS MATERIALIZED (SELECT * FROM lines WHERE {_TEST})"""


def te_sql(keys: list[str], train: str = "train", rows: str = "test", smoothing: float = 10.0, name: str = "enc") -> str:
    k = ", ".join(keys)
    return f"""SELECT r.row_id, round((coalesce(t, 0) + m * {smoothing}e0) / (coalesce(n, 0) + {smoothing}e0), 6) AS {name}
FROM {rows} r CROSS JOIN (SELECT avg(y) AS m FROM {train})
LEFT JOIN (SELECT {k}, sum(y) AS t, count(*) AS n FROM {train} GROUP BY {k}) USING ({k})"""


def _keyed(spark: SparkSession, sf_dir: str, *categories: str) -> DataFrame:
    """Key, label and categories of ``lines``, staged, as encodings read them several times."""
    return stage(lines(spark, sf_dir).select("row_id", "y", *categories), "zstd")


def _folded(spark: SparkSession, sf_dir: str, *categories: str) -> DataFrame:
    return as_staged(shuffled_folds(_keyed(spark, sf_dir, *categories), 5))


def _encoded(df: DataFrame, name: str = "enc") -> DataFrame:
    return df.select("row_id", F.round(name, 6).alias(name))


@query("j1_category_lookup", f"WITH {_SPLIT_SQL} {te_sql(['l_suppkey', 'seg_brand'])}")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(_keyed(spark, sf_dir, "l_suppkey", "seg_brand"))
    return _encoded(encoding.target_encode(train, test, ["l_suppkey", "seg_brand"], "enc"))


@query("f4_target_encode", f"WITH {_SPLIT_SQL} {te_sql(['l_suppkey'], smoothing=2.0)}")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(_keyed(spark, sf_dir, "l_suppkey"))
    return _encoded(encoding.target_encode(train, test, ["l_suppkey"], "enc", smoothing=2.0))


# The category of one supplier goes missing; the SQL leaves it its name, as a missing category is one like any other.
@query("f4_target_encode_null", f"WITH {_SPLIT_SQL} {te_sql(['l_suppkey'], smoothing=2.0)}")
def f4_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(_keyed(spark, sf_dir, "l_suppkey").withColumn("l_suppkey", F.nullif("l_suppkey", F.lit(3))))
    return _encoded(encoding.target_encode(train, test, ["l_suppkey"], "enc", smoothing=2.0))


_FOLD5 = f"""fold5 AS MATERIALIZED (SELECT * EXCLUDE (rn, n), {stack_sql('rn', 'n', 5)} AS fold FROM (
  SELECT *, row_number() OVER (ORDER BY {hash_sql('fold')}, row_id) - 1 AS rn, count(*) OVER () AS n FROM lines))"""


def oof_sql(keys: list[str], rows: str = "fold5", smoothing: float = 10.0, name: str = "enc") -> str:
    k = ", ".join(keys)
    return f"""SELECT r.row_id, round((coalesce(a.t, 0) - coalesce(o.t, 0) + m * {smoothing}e0)
  / (coalesce(a.n, 0) - coalesce(o.n, 0) + {smoothing}e0), 6) AS {name}
FROM {rows} r CROSS JOIN (SELECT avg(y) AS m FROM {rows})
LEFT JOIN (SELECT {k}, sum(y) AS t, count(*) AS n FROM {rows} GROUP BY {k}) a USING ({k})
LEFT JOIN (SELECT {k}, fold, sum(y) AS t, count(*) AS n FROM {rows} GROUP BY {k}, fold) o USING ({k}, fold)"""


@query("j2_category_fold_lookup", f"WITH {LINES_SQL}, {_FOLD5} {oof_sql(['o_custkey'])}")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(encoding.target_encode_oof(_folded(spark, sf_dir, "o_custkey"), ["o_custkey"], "enc"))


@query("f5_target_encode_oof", f"WITH {LINES_SQL}, {_FOLD5} {oof_sql(['seg_brand'])}")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(encoding.target_encode_oof(_folded(spark, sf_dir, "seg_brand"), ["seg_brand"], "enc"))


@query("f6_pair_encode", f"WITH {LINES_SQL}, {_FOLD5} {oof_sql(['seg_brand', 'p_type'])}")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = _folded(spark, sf_dir, "seg_brand", "p_type")
    return _encoded(encoding.target_encode_oof(folded, ["seg_brand", "p_type"], "enc"))


@query("f7_frequency_encode", f"""WITH {EVENTS_SQL},
train AS (SELECT * FROM ev WHERE NOT ({_TEST})), test AS (SELECT * FROM ev WHERE {_TEST})
SELECT row_id, round(ln(1e0 + coalesce(n, 0) / CAST((SELECT count(*) FROM train) AS DOUBLE)), 9) AS enc
FROM test LEFT JOIN (SELECT user_id, count(*) AS n FROM train GROUP BY user_id) USING (user_id)""")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(events(spark, sf_dir))
    return encoding.frequency_encode(train, test, "user_id", "enc").select("row_id", F.round("enc", 9).alias("enc"))


CATEGORIES = (
    "seg_brand", "p_type", "l_suppkey", "o_custkey", "seg_priority", "l_partkey", "l_quantity", "l_discount", "l_tax"
)
BASE_SET = encoding.FeatureSet(
    CATEGORIES, (("seg_priority", "l_tax"), ("seg_brand", "p_type"), ("p_type", "l_partkey"), ("l_suppkey", "o_custkey"))
)
WIDE_SET = encoding.FeatureSet(
    CATEGORIES,
    BASE_SET.pairs + (("seg_brand", "seg_priority"), ("p_type", "l_tax"), ("o_custkey", "l_quantity"), ("l_partkey", "l_discount")),
    counts=("seg_brand", "p_type", "seg_priority", "l_quantity", "l_tax"),
    smoothing=2.0,
)


def _set_sql(fs: encoding.FeatureSet) -> str:
    """Every encoded column of the training rows, joined on the row key."""
    def src(sql: str, i: int) -> str:
        return f"JOIN ({sql}) e{i} USING (row_id)"

    keyed = [([c], fs.smoothing) for c in fs.categories] + [(list(p), fs.pair_smoothing) for p in fs.pairs]
    joins = [src(oof_sql(keys, smoothing=s, name=n), i) for i, ((keys, s), n) in enumerate(zip(keyed, fs.names))]
    counts = ", ".join(
        f"round(ln(1e0 + count(*) OVER (PARTITION BY {c}) / CAST(count(*) OVER () AS DOUBLE)), 6) AS freq_{c}" for c in fs.counts
    )
    base = f"(SELECT row_id{', ' + counts if counts else ''} FROM fold5)"
    return f"WITH {LINES_SQL}, {_FOLD5} SELECT row_id, {', '.join(fs.names)} FROM {base} {' '.join(joins)}"


def _set(spark: SparkSession, sf_dir: str, fs: encoding.FeatureSet) -> DataFrame:
    rows = fs.train_rows(_folded(spark, sf_dir, *fs.categories))
    return tables.rounded(rows, fs.names).select("row_id", *fs.names)


@query("f8_feature_set", _set_sql(BASE_SET))
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set(spark, sf_dir, BASE_SET)


@query("f8_feature_set_wide", _set_sql(WIDE_SET))
def f8_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set(spark, sf_dir, WIDE_SET)


def _test_set_sql(fs: encoding.FeatureSet) -> str:
    """Every encoded column of the other rows."""
    keyed = [([c], fs.smoothing) for c in fs.categories] + [(list(p), fs.pair_smoothing) for p in fs.pairs]
    joins = [f"JOIN ({te_sql(keys, smoothing=s, name=n)}) e{i} USING (row_id)" for i, ((keys, s), n) in enumerate(zip(keyed, fs.names))]
    freqs = [
        f"""JOIN (SELECT row_id, round(ln(1e0 + coalesce(n, 0) / CAST((SELECT count(*) FROM train) AS DOUBLE)), 6) AS freq_{c} FROM test
          LEFT JOIN (SELECT {c}, count(*) AS n FROM train GROUP BY {c}) USING ({c})) f{i} USING (row_id)"""
        for i, c in enumerate(fs.counts)
    ]
    return f"WITH {_SPLIT_SQL} SELECT row_id, {', '.join(fs.names)} FROM (SELECT row_id FROM test) {' '.join(joins + freqs)}"


@query("f8_feature_set_test", _test_set_sql(WIDE_SET))
def f8_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(_keyed(spark, sf_dir, *CATEGORIES))
    return tables.rounded(WIDE_SET.other_rows(train, test), WIDE_SET.names).select("row_id", *WIDE_SET.names)


# --- binning --------------------------------------------------------------------------


@query("f1_cut_points", f"WITH {LINES_SQL}, {bins_sql('lines', 255)} SELECT feature, bin, upper FROM thr")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_points(lines(spark, sf_dir), FEATURES, 255)


_B = ", ".join(f"b{i}" for i in range(len(FEATURES)))


@query("f2_bin_rows", f"WITH {LINES_SQL}, {bins_sql('lines', 255)} SELECT row_id, {_B} FROM binned")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = staged_lines(spark, sf_dir)
    coded = base.select("row_id", fit_binner(base, FEATURES, 255).codes().alias("codes"))
    return coded.select("row_id", *[F.pmod(F.col("codes")[i], F.lit(256)).alias(f"b{i}") for i in range(len(FEATURES))])


@query("f3_bin_counts", f"""WITH {LINES_SQL}, {bins_sql('lines', 255)}
SELECT feature, CAST(count(*) AS BIGINT) AS n_bins FROM thr GROUP BY feature""")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_points(lines(spark, sf_dir), FEATURES, 255).groupBy("feature").agg(F.count("*").alias("n_bins"))


@query("j3_bin_lookup", f"""WITH {_SPLIT_SQL}, {bins_sql('train', N_BINS)},
long AS ({' UNION ALL '.join(f'SELECT row_id, {i} AS feature, {f} AS v FROM test' for i, f in enumerate(FEATURES))})
SELECT l.row_id, l.feature, CAST(min(t.bin) AS INTEGER) AS bin FROM long l JOIN thr t ON t.feature = l.feature AND t.upper >= l.v
GROUP BY l.row_id, l.feature""")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(staged_lines(spark, sf_dir))
    coded = test.select("row_id", F.explode(fit_binner(train, FEATURES, N_BINS).codes()).alias("code"))
    return coded.select("row_id", F.shiftright("code", 8).alias("feature"), F.pmod("code", F.lit(256)).alias("bin"))
