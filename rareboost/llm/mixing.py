"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

The mix holds ``share`` times the words of the corpus. Sources weigh 5, 2, 1,
repeating, in code point order with null last; a target stops at twice the size
of its source, and what is over is shared again by weight until no target is
above that. Each source is taken in whole epochs first. The rest of its target
is a weighted sample without replacement: every document draws an exponential
key, divided by its quality weight, and documents are taken in the order of
their keys while the running sum of words meets the budget; the document at the
edge is taken if that comes closer to the target.

A quality weight is the share of characters that are neither digits nor symbols.
Running sums go over range blocks of (source, key), so a large source is spread
over many tasks; sources are a table that the planner broadcasts only by its
measured size, and the shares are settled by a few sums over it.

Edge cases: a null source is a source of its own; null texts and texts without
words have size 0 and take none; rows that agree in id, source and text share
one key, and where they straddle the edge of a budget as many of them are taken
as come closest to it, in the order of a hash of the whole row; an empty table
gives no rows. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rareboost.functions.ranking import global_rank, running_sums
from rareboost.llm.columns import ROW, hash56, unpacked, word_count
from rareboost.session import stage, unstage

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
MARKS = "0123456789#*$%&|<>!"
UNIT = ["_id", "_src", "_none", "_text"]


def quality_weight(text: Column) -> Column:
    """Share of characters that are neither digits nor symbols, 0.05 at least."""
    n = F.length(text)
    return F.when(n > 0, F.greatest(F.length(F.translate(text, MARKS, "")) / n, F.lit(0.05))).otherwise(F.lit(1.0))


def _unit(key: str, source: str, text: str) -> list[Column]:
    """What names a document: id, source and text."""
    return [
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_src"),
        F.col(source).isNull().alias("_none"), F.xxhash64(F.col(text)).alias("_text"),
    ]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Of _src, _none and source_size: each source's target. One row per source throughout."""
    ranked = stage(global_rank(sizes, [F.col("_none"), F.col("_src")]))
    weight = F.element_at(F.lit(list(weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    sources = ranked.withColumn("weight", weight).withColumn("most", most * F.col("source_size"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("most") < level * F.col("weight")
        capped = sources.agg(F.count_if(over), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))).first()
        if capped[0] == full or not capped[2]:
            break
        full, level = capped[0], (share * total - (capped[1] or 0)) / capped[2]
    return sources.select("_src", "_none", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("most").cast("double")).alias("target"))


def plan(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weight: Column | None = None, seed: int = 42) -> DataFrame:
    """One staged row per distinct document: size, source_size, target and the times it is taken.

    ``_part`` is 0, or the number of its equal rows that are taken once more than
    ``times`` says; at most one document of a source has such a part.
    """
    weight = quality_weight(F.col(text)) if weight is None else weight
    rows = docs.select(*_unit(key, source, text), word_count(F.col(text)).alias("size"), weight.alias("w"))
    units = stage(rows.groupBy(*UNIT).agg(F.first("size").alias("size"), F.first("w").alias("w"), F.count("*").alias("n")))
    sizes = units.groupBy("_src", "_none").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes)
    u = (hash56(F.lit("mix"), F.lit(seed), F.col("_id")) + 0.5) / float(1 << 56)
    keyed = units.withColumn("_key", -F.ln(u) / F.col("w"))
    summed = running_sums(keyed, [F.col("_key"), F.col("_id"), F.col("_text")], {"_sum": F.col("size") * F.col("n")}, ["_src", "_none"])
    placed = summed.join(targets, ["_src", "_none"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    # A row is taken if half of it fits; of n equal rows all are if half of the last one does.
    fits = F.col("_sum") - F.col("size") / 2 <= rest
    before = F.col("_sum") - F.col("size") * F.col("n")
    part = F.floor((rest - before) / F.greatest("size", F.lit(1)) + 0.5).cast("long")
    some = (F.col("size") > 0) & (F.col("n") > 1) & (F.col("_epochs") < MOST) & ~fits
    out = placed.withColumn("_epochs", epochs).withColumn("times", F.col("_epochs") + F.when(fits & (F.col("_epochs") < MOST), 1).otherwise(0))
    out = out.withColumn("_part", F.when(some, F.greatest(F.lit(0), F.least(part, F.col("n") - 1))).otherwise(0).cast("long"))
    staged = stage(out.select(*UNIT, "size", "source_size", "target", "times", "_part"))
    unstage(units)
    return staged


def mixed(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weight: Column | None = None) -> DataFrame:
    """Every row with size, source_size, target, times and taken, the words that the mix takes of it."""
    return apply_plan(docs, plan(docs, key=key, source=source, text=text, weight=weight), key=key, source=source, text=text)


def apply_plan(docs: DataFrame, chosen: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    new = ("size", "source_size", "target", "times", "taken")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), *_unit(key, source, text))
    found = rows.join(chosen, UNIT)
    if not chosen.where("_part > 0").isEmpty():
        # Equal rows at the edge of a budget are numbered; the salt, frozen by staging, spreads them over range blocks.
        edge = stage(found.where("_part > 0").withColumn("_salt", F.monotonically_increasing_id()))
        numbered = running_sums(edge, [F.xxhash64(F.to_json(ROW)), F.col("_salt")], {"_nth": F.lit(1)}, UNIT)
        once_more = F.when(F.col("_nth") <= F.col("_part"), 1).otherwise(0)
        found = found.where("_part = 0").unionByName(numbered.withColumn("times", F.col("times") + once_more).select(found.columns))
    return unpacked(found, docs.columns, {c: F.col(c) for c in new[:-1]} | {"taken": F.col("times") * F.col("size")})


def draw(docs: DataFrame, **names: str) -> DataFrame:
    """The mix itself: each document as often as it is taken, in the columns of ``docs``."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    chosen = apply_plan(docs.select(F.struct(*columns).alias("_row"), *[F.col(names.get(c, d)).alias(d) for c, d in (("key", "doc_id"), ("source", "source"), ("text", "text"))]), plan(docs, **names))
    # At most MOST + 1 copies of a row.
    copies = chosen.where("size > 0 and times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return copies.select("_row.*")
