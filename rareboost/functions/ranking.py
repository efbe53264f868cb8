"""Global ranks and running sums without a single-task window.

Rows are range-partitioned by the full order (a hot value is split by the
remaining keys), staged once so that the sampled range bounds are frozen,
and numbered inside their block. Only per-block totals are summed globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rareboost.functions.joins import null_safe_join
from rareboost.session import stage


def range_blocks(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``_slot``: increasing in ``order``; its upper bits name the block."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ranged.withColumn("_slot", F.monotonically_increasing_id()))


def _block() -> Column:
    return F.shiftright("_slot", 33)


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """Add inclusive running sums of ``sums`` in ``order``, restarted per ``group``.

    Group columns lead the range partitioning, so a group larger than a block is
    spread over several of them; ``order`` must tell the rows of a group apart.
    """
    group = group or []
    ranged = range_blocks(df, [F.col(g) for g in group] + order).withColumn("_block", _block())
    local = Window.partitionBy("_block", *group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(c).over(local).alias(f"_in_{n}") for n, c in sums.items()])
    totals = ranged.groupBy("_block", *group).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    # One row per (group, block): block counts are bounded by the shuffle partitions.
    before = Window.partitionBy(*(group or [F.lit(1)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_block", *group, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in sums])
    joined = null_safe_join(out, offsets, ["_block", *group])
    return joined.select(
        *[F.col(c) for c in df.columns], *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(n) for n in sums]
    )


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the 0-based position of every row in ``order`` (which must end in a unique key)."""
    ranged = range_blocks(df, order)
    counts = sorted(ranged.groupBy(_block().alias("b")).count().collect(), key=lambda r: r["b"])
    starts, total = [], 0
    for r in counts:
        starts.append((r["b"], total))
        total += r["count"]
    spark = df.sparkSession
    # One row per shuffle partition, so the broadcast does not grow with the table.
    offsets = F.broadcast(spark.createDataFrame(starts, "_block long, _start long"))
    local = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranged.withColumn("_block", _block())
        .join(offsets, "_block", "left")
        .select(*df.columns, (F.col("_start") + local).alias(name))
    )
