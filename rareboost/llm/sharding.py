"""Proportional stratified interleaving: every shard holds the corpus mixture.

Rows are shuffled within their source by a seeded hash, ranked, and laid out by
fractional rank, ``(rank - 1 + phase) / rows of the source``. Cutting that order
into equal runs gives each shard its share of each source, give or take a row.
The phase of a source comes from its name; it spreads small sources over the
shards, which would otherwise all meet in the middle one.

No source and no run is ever sorted by one task. Ranks are counted in hash
blocks of a source and offset by the totals of the blocks before; positions are
counted in blocks of the fractional rank, which is even by construction.

Edge cases: a null source is a source of its own; null texts and ids are rows
like any other; repeated rows get slots of their own; an empty table gives no
rows. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rareboost.llm.columns import ROW, field, hash56, packed, unpacked

ROWS_PER_BLOCK = 2_000
MAX_BLOCKS = 1 << 15


def n_blocks(n_rows: int) -> int:
    """Power of two that keeps a block near ROWS_PER_BLOCK rows; results do not depend on it."""
    return min(MAX_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, n_rows / ROWS_PER_BLOCK)))))


def interleave(
    docs: DataFrame, n_shards: int = 16, *, key: str = "doc_id", source: str = "source", tie: Column | None = None, seed: int = 42
) -> DataFrame:
    """Add ``shard`` and ``slot`` (0-based, gapless in the shard) to every row.

    ``tie`` tells rows of one key apart; by default the md5 of ``text``.
    """
    n_rows = docs.count()
    blocks = n_blocks(n_rows)
    tie = F.md5(field("text")) if tie is None else tie
    rows = packed(docs).select(
        ROW,
        F.coalesce(field(source), F.lit("")).alias("_src"),
        field(source).isNull().alias("_none"),
        hash56(F.lit("shard"), F.lit(seed), field(key), tie).alias("_h"),
    )
    rows = rows.withColumn("_block", F.floor(F.col("_h") / F.lit(float(1 << 56)) * blocks).cast("int"))
    stratum = ["_src", "_none"]
    before = Window.partitionBy(*stratum).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # At most `blocks` rows per source.
    strata = (
        rows.groupBy(*stratum, "_block").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_of", F.sum("_n").over(Window.partitionBy(*stratum)))
    )
    phase = (F.pmod(hash56(F.lit("phase"), F.lit(seed), F.col("_src"), F.col("_none")), F.lit(1024)) + 0.5) / 1024.0

    def place(rank: Column) -> Column:
        return (rank - 1 + phase) / F.col("_of")

    def part(place_: Column) -> Column:
        return F.least(F.floor(place_ * blocks).cast("int"), F.lit(blocks - 1))

    in_block = Window.partitionBy(*stratum, "_block").orderBy("_h", ROW) if _orderable(docs) else Window.partitionBy(*stratum, "_block").orderBy("_h")
    ranked = (
        rows.join(strata, [*stratum, "_block"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(in_block))
        .withColumn("_place", place(F.col("_rank")))
        .withColumn("_part", part(F.col("_place")))
    )
    spread = strata.select(*stratum, "_of", F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + F.col("_n"))).alias("_rank"))
    counts = spread.groupBy(part(place(F.col("_rank"))).alias("_part")).count().collect()  # at most `blocks` rows
    starts, total = [], 0
    for row in sorted(counts, key=lambda r: r["_part"]):
        starts.append((row["_part"], total))
        total += row["count"]
    starts_df = F.broadcast(docs.sparkSession.createDataFrame(starts, "_part int, _start long"))  # at most `blocks` rows
    in_part = Window.partitionBy("_part").orderBy("_place", "_none", "_src", "_rank")
    laid = ranked.join(starts_df, "_part").withColumn("_pos", F.col("_start") + F.row_number().over(in_part) - 1)
    shard = F.expr(f"_pos * {n_shards} div {max(1, n_rows)}")
    laid = laid.withColumn("_shard", shard)
    slot = F.col("_pos") - F.expr(f"(_shard * {n_rows} + {n_shards - 1}) div {n_shards}")
    return unpacked(laid, docs.columns, {"shard": F.col("_shard").cast("int"), "slot": slot.cast("long")})


def _orderable(docs: DataFrame) -> bool:
    """Whether whole rows can break ties of the hash (maps and variants have no order)."""
    return not any(t in kind for _, kind in docs.dtypes for t in ("map<", "variant"))
