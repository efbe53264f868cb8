"""Rows carried whole, so that working columns never clash with the caller's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROW = "_row"


def field(name: str) -> Column:
    """A column of a packed row."""
    return F.col(ROW).getField(name)


def packed(df: DataFrame) -> DataFrame:
    """One struct column that holds every column of ``df``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def unpacked(df: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """The packed columns followed by ``new``, which replace columns of the same name."""
    taken = {n.lower() for n in new}
    kept = [field(c).alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def hash56(*parts: Column) -> Column:
    """56 bits of an md5 over the parts (nulls are skipped), as a non-negative long."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")
