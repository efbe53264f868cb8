"""Sources and sinks of labelled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from rareboost.session import stage


def _numbers(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def read_labelled_csv(spark: SparkSession, path: str, features: list[str], label: str = "y") -> DataFrame:
    """Headerless CSV of numbers with the label last; a bad number fails the read."""
    return read_features_csv(spark, path, [*features, label])


def read_features_csv(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """Headerless CSV of numbers; blanks around a field are ignored."""
    return spark.read.csv(
        path, schema=_numbers(features), header=False, mode="FAILFAST",
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )


def write_features(df: DataFrame, path: str, features: list[str], label: str | None = None) -> None:
    """Headerless CSV of features (and label last), values rounded to six decimals."""
    names = [*features, *([label] if label else [])]
    rounded(df, names).select(*names).write.mode("overwrite").csv(path, header=False)


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def write_predictions(df: DataFrame, path: str, column: str = "p") -> None:
    """Row key and probability to six decimals, as Parquet."""
    rounded(df, [column]).select("row_id", column).write.mode("overwrite").parquet(path)


def with_row_key(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add a key made of the row's content and the number of its occurrence.

    Equal rows are numbered within the blocks of a staged copy, and the blocks
    are offset by the counts before them, so a row that occurs often is not
    numbered by one task. The keys do not depend on the order of the rows.
    """
    content = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    blocks = stage(df.withColumns({"_content": content, "_block": F.spark_partition_id()}))
    before = Window.partitionBy("_content").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.groupBy("_content", "_block").agg(F.count("*").alias("_n"))
    offsets = counts.select("_content", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_content", "_block").orderBy(F.lit(1)))
    keyed = blocks.join(offsets, ["_content", "_block"]).withColumn("_number", number + F.col("_before"))
    key = F.concat_ws("-", F.substring("_content", 1, 32), F.col("_number").cast("string"))
    return keyed.select(key.alias(name), *[F.col(f"`{c}`") for c in df.columns])


def labelled_table(df: DataFrame, features: list[str], label: str = "y", keep: list[str] | None = None) -> DataFrame:
    """``row_id``, label and features as doubles; rejects an empty table, missing labels, and NULL or repeated keys."""
    return checked(labelled(df, features, label, keep))


def labelled(df: DataFrame, features: list[str], label: str = "y", keep: list[str] | None = None) -> DataFrame:
    """The same columns, unchecked. A table without ``row_id`` gets one by ``with_row_key``."""
    if "row_id" not in df.columns:
        df = with_row_key(df)
    missing = [c for c in ["row_id", label, *features, *(keep or [])] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(
        "row_id", F.col(label).cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in features],
        *[c for c in keep or [] if c not in features],
    )


def checked(table: DataFrame) -> DataFrame:
    """A labelled table, once it holds what training relies on; stage it first, as this reads it twice."""
    bad = F.col("y").isNull() | F.isnan("y")
    check = table.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(F.col("row_id").isNull()).alias("nameless")).first()
    if check["n"] == 0:
        raise ValueError("empty training set")
    if check["bad"]:
        raise ValueError(f"{check['bad']} rows without a label")
    if check["nameless"]:
        raise ValueError(f"{check['nameless']} rows without a row_id")
    named = table.select("row_id", F.xxhash64("row_id").alias("_h"))
    met = named.groupBy("_h").count().where("count > 1").select("_h")
    # Only the names of rows whose hashes meet are shuffled and compared.
    if not met.isEmpty() and not named.join(met, "_h", "left_semi").groupBy("row_id").count().where("count > 1").isEmpty():
        raise ValueError("row_id repeats")
    return table


def attach(df: DataFrame, side: DataFrame, columns: list[str]) -> DataFrame:
    """Add segment or time columns of a side table by ``row_id``; NULL where absent."""
    return df.join(side.select("row_id", *columns), "row_id", "left")


def subset(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose ``row_id`` occurs in ``keys``."""
    return df.join(keys.select("row_id"), "row_id", "left_semi")
