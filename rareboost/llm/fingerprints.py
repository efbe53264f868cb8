"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

The set of a text is its distinct 5-word shingles (A-Z lower-cased, words are
runs of characters other than space and tab to carriage return; with fewer words,
the whole sequence). Every shingle is hashed once, to 64 bits: the upper 8 name
one of 256 bins, and a bin keeps its least hash. An empty bin takes the value of
the first filled bin on a probe sequence of its own, the same for all documents:
``(step * t + start) mod 256`` for t = 0, 1, ... with an odd step, which visits
every bin. Of each bin's value the low 4 bits are stored, 16 bins to a long. The
share of equal bins is corrected for the 1 in 16 that agree by chance.

Native: every step is a built-in function over one row, the minima come from one
sort of a row's hashes, and nothing goes to Python. ``with_next`` moves whole
texts once (the exchange on the row's key is used twice) and the heads of the
next documents, a third of the texts at most.

Edge cases: null texts are empty. A text without words has no shingles and the
empty fingerprint; it is like another without words (1) and unlike all else (0).
Documents are ordered by falling id, null ids last, texts of one id by their
hash; rows that agree in id and text are one document that all of them report.
A single document is its own next one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from rareboost.functions.ranking import global_rank

# Fixed shape of a fingerprint; 16 bins of 4 bits fill a long.
WORDS, BINS, BITS, BIN_SHIFT = 5, 256, 4, 56
PER_LONG = 64 // BITS
EMPTY = (1 << BIN_SHIFT) - 1
#: Probes tried one by one before the first hit is computed from the filled bins.
TRIED = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def probes() -> tuple[list[int], list[int]]:
    """Start and odd step of every bin's probe sequence, from md5 of its number."""
    drawn = [hashlib.md5(f"bin-{i}".encode()).digest() for i in range(BINS)]
    return [d[0] for d in drawn], [d[1] | 1 for d in drawn]


def _constants(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: an expression that a lambda repeats would be computed by each call."""
    return F.get(F.transform(F.array(value), body), 0)


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def _bin(value: Column) -> Column:
    return (F.shiftright(value, BIN_SHIFT) + BINS // 2).cast("int")


def _is_empty(value: Column) -> Column:
    return value.bitwiseAND(F.lit(EMPTY)) == EMPTY


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: 16 longs of packed bins, or null where ``text`` has no words."""
    starts, steps = probes()
    inverse = [pow(s, -1, BINS) for s in steps]
    n = F.size("_words")

    def shingles(words: Column) -> Column:
        # Entries by position: a slice inside a lambda would copy the whole array each time.
        return F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)]))

    whole = F.array(F.xxhash64(F.concat_ws(" ", "_words")))
    hashes = F.when(n < WORDS, whole).otherwise(_bound(F.transform(F.col("_words"), lambda w: F.xxhash64(w)), shingles))
    # One mark at the end of every bin, so that each bin has a first entry and empty bins show.
    marks = F.expr(f"transform(sequence({-BINS // 2}, {BINS // 2 - 1}), i -> shiftleft(cast(i as bigint), {BIN_SHIFT}) + {EMPTY})")
    before = lambda i: F.get(F.col("_sorted"), i - 1)
    first = F.filter(F.col("_sorted"), lambda x, i: (i == 0) | (F.shiftright(x, BIN_SHIFT) != F.shiftright(before(i), BIN_SHIFT)))
    filled = F.transform(F.filter(F.col("_bins"), lambda x: ~_is_empty(x)), _bin)

    def dense(x: Column, i: Column, filled: Column) -> Column:
        tried = F.when(~_is_empty(x), x)
        for t in range(TRIED):
            there = F.get(F.col("_bins"), F.get(_constants([(s * t + b) % BINS for s, b in zip(steps, starts)]), i))
            tried = tried.when(~_is_empty(there), there)
        # The filled bin that the sequence reaches first: t = (bin - start) / step, modulo the number of bins.
        order = F.transform(
            filled,
            lambda j: F.shiftleft(((j - F.get(_constants(starts), i)) * F.get(_constants(inverse), i)).bitwiseAND(F.lit(BINS - 1)), 8) + j,
        )
        return tried.otherwise(F.get(F.col("_bins"), F.array_min(order).bitwiseAND(F.lit(BINS - 1))))

    low = F.lit((1 << BITS) - 1).cast("long")

    def pack(values: Column) -> Column:
        join = lambda acc, x: F.shiftleft(acc, BITS) + x.bitwiseAND(low)
        one = lambda w: F.aggregate(F.slice(values, w * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"), join)
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), one)

    densified = _bound(filled, lambda f: F.transform(F.col("_bins"), lambda x, i: dense(x, i, f)))
    return (
        df.select("*", word_list(F.col(text)).alias("_words"))
        .withColumn("_sorted", F.sort_array(F.concat(hashes, marks)))
        .withColumn("_bins", first)
        .select(*[F.col(c) for c in df.columns], F.when(n > 0, _bound(densified, pack)).alias(name))
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two texts by their fingerprints, 0 to 1; exact for equal ones."""
    ones = F.lit(int("1" * PER_LONG, 16))

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        any_bit = z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseOR(F.shiftrightunsigned(z, 3))
        return F.bit_count(any_bit.bitwiseAND(ones))

    differ = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda acc, d: acc + d)
    chance = 1.0 / (1 << BITS)
    corrected = ((F.lit(BINS) - differ).cast("double") / BINS - chance) / (1 - chance)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(corrected, F.lit(0.0)))


def as_text(packed: Column) -> Column:
    """One hexadecimal digit per bin; empty for no words."""
    digits = F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), PER_LONG, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


_KEY = ["_id", "_none", "_hash"]


def _units(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows under names of their own: the id (0 where null), whether it is null, a hash of the text, the text."""
    kind = df.schema[key].dataType.simpleString()
    nothing = F.lit("" if kind == "string" else 0).cast(kind)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return df.select(
        F.coalesce(F.col(f"`{key}`"), nothing).alias("_id"), F.col(f"`{key}`").isNull().alias("_none"),
        F.xxhash64(body).alias("_hash"), body.alias("_text"),
    )


def with_next(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's id, text, edited text, the fingerprints of both and of the next document.

    The edited text ends in the next document's beginning: its last
    ``floor(n_chars / 3)`` code points are replaced by as many of the next one's first (or all).
    """
    units = _units(df, key, text)
    cut = F.floor(F.char_length("_text") / 3).cast("int")
    order = [F.col("_none"), F.col("_id").desc(), F.col("_hash")]
    narrow = units.select(*_KEY, cut.alias("cut")).dropDuplicates(_KEY)
    ranked = global_rank(narrow, order)
    n = ranked.count()
    after = ranked.select(((F.col("rank") + (n - 1)) % max(n, 1)).alias("rank"), *_KEY)
    # One row per document: the next one's key, its own, and the length it wants.
    wants = ranked.select("rank", F.struct(*_KEY).alias("to"), "cut").join(after, "rank").drop("rank")
    # Both sides of the last join read this table whole, so that its exchange is made once.
    base = (
        fingerprint(units, "_text", "_print").groupBy(*_KEY)
        .agg(F.first("_text").alias("_text"), F.first("_print").alias("_print"), F.count("*").alias("_rows"))
        .where("_rows > 0")
    )
    heads = base.join(wants, _KEY).select(
        *[F.col(f"to.{c}").alias(c) for c in _KEY],
        F.when(F.col("cut") > 0, F.substring("_text", F.lit(1), F.col("cut"))).otherwise("").alias("_head"),
        "cut", F.col("_print").alias("_next"),
    )
    own = F.substring("_text", F.lit(1), F.char_length("_text") - F.col("cut"))
    edited = base.join(heads, _KEY).withColumn("_edited", F.concat(own, F.col("_head")))
    out = fingerprint(edited, "_edited", "_edited_print")
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_copy"))
    return out.select(
        F.when(~F.col("_none"), F.col("_id")).alias(key), F.col("_text").alias("text"), F.col("_edited").alias("edited"),
        F.col("_print").alias("print"), F.col("_edited_print").alias("edited_print"), F.col("_next").alias("next_print"),
    )
