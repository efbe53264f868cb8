"""URL filters by a cascade of Bloom filters: exact membership without joins.

The first filter holds the listed keys. The second holds the keys of the corpus
that the first takes for listed, the third the listed keys that the second takes
for those, and so on, until a level takes nothing wrongly. With levels numbered
from 0, a key is listed if the first level that turns it away has an odd number
or, where none does, if the number of levels is odd. Over the complete key
universe of the corpus, on which the cascade is built, the answer is exact.

Levels are bit arrays whose size follows the number of LISTED keys: the first
is wide enough to let through about as many other keys as there are listed ones,
the others need a few bits a key. They are made by grouped bit sums and become
constants of the final projection, so urls are judged in one narrow pass.

Keys of a url are the suffixes of its host with as many labels as some rule has,
followed by the prefixes of its path as long as some rule's path.

Edge cases: a null url, or one without ``://``, has empty host and path and no
rule; a repeated url is judged alike each time; an empty table gives no rows; an
empty list allows everything.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rareboost.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Listed keys that may be held as constants of a plan; larger lists are split by the caller.
MAX_LISTED = 100_000
MAX_LEVELS = 64


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """A Bloom filter: ``words`` of 64 bits and the number of hashes per key."""

    number: int
    words: tuple[int, ...]
    n_hashes: int

    def holds(self, key: Column) -> Column:
        words, bits = F.lit(list(self.words)), 64 * len(self.words)

        def is_set(i: int) -> Column:
            at = place(key, self.number, i, bits)
            word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
            return F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1

        return reduce(lambda a, b: a & b, [is_set(i) for i in range(self.n_hashes)])


def place(key: Column, level: int, i: int, bits: int) -> Column:
    """Bit of a key in a level under the i-th hash."""
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is on the list."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            answer = F.when(~self.levels[k].holds(key), F.lit(k % 2 == 1)).otherwise(answer)
        return answer


def build_level(number: int, keys: DataFrame, n_keys: int, n_others: int) -> Level:
    """A filter of ``keys`` that lets about as many of the others through as it holds, or half of them."""
    n_hashes = math.ceil(math.log2(max(2.0, n_others / n_keys)))
    words = math.ceil(n_keys * n_hashes * 1.44 / 64)
    bits = keys.select(F.explode(F.array(*[place(F.col("key"), number, i, 64 * words) for i in range(n_hashes)])).alias("at"))
    word_bits = F.bit_or(F.expr("shiftleft(1L, cast(pmod(at, 64) as int))"))
    rows = bits.groupBy(F.shiftright("at", 6).alias("word")).agg(word_bits.alias("bits")).collect()  # at most `words` rows
    made = dict((r["word"], r["bits"]) for r in rows)
    return Level(number, tuple(made.get(i, 0) for i in range(words)), n_hashes)


def build_cascade(universe: DataFrame, listed: list[str]) -> Cascade:
    """The cascade that tells ``listed`` from all other keys of ``universe`` (one column ``key``, distinct)."""
    listed = sorted(set(listed))
    if len(listed) > MAX_LISTED:
        raise ValueError(f"{len(listed)} listed keys; a cascade holds at most {MAX_LISTED}")
    if not listed:
        return Cascade(())
    mine = F.broadcast(universe.sparkSession.createDataFrame([(k,) for k in listed], "key string"))  # at most MAX_LISTED rows
    include, exclude = mine, universe.join(mine, "key", "left_anti")
    n_include, n_exclude, levels = len(listed), exclude.count(), []
    while True:
        levels.append(build_level(len(levels), include, n_include, n_exclude))
        # About as many as there are keys in the level, whatever the size of the universe.
        wrong = stage(exclude.where(levels[-1].holds(F.col("key"))))
        n_wrong = wrong.count()
        if not n_wrong:
            return Cascade(tuple(levels))
        if len(levels) == MAX_LEVELS:
            raise ValueError("the cascade does not end: two keys hash alike in every level")
        include, exclude, n_include, n_exclude = wrong, include, n_wrong, n_include


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty without ``://``."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(there, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(there, path).otherwise("")


def url_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Every key under which a rule may list a url of this host and path."""
    labels = sorted({r.host.count(".") + 1 for r in rules})
    lengths = sorted({len(r.path) for r in rules})
    keys = [
        F.when((F.length(path) >= n) & (F.length(host) > 0), F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n)))
        for k in labels for n in lengths
    ]
    return F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: list[Rule], *, url: str = "url", default: str = "allow") -> DataFrame:
    """The pages with host, path, rule and verdict; input columns of these names are replaced.

    The longest rule that fits decides; where none does, ``default``.
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = parts(F.col(f"`{url}`"))
    found = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    keys = url_keys(F.col("host"), F.col("path"), rules)
    universe = stage(pages.select(host.alias("host"), path.alias("path")).select(F.explode(keys).alias("key")).distinct())
    cascades = {v: build_cascade(universe, [r.key for r in rules if r.verdict == v]) for v in sorted({r.verdict for r in rules})}
    fits = F.filter(keys, lambda k: reduce(lambda a, b: a | b, [c.listed(k) for c in cascades.values()], F.lit(False)))
    rule = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    judged = found.withColumn("rule", rule)
    verdict = F.lit(default)
    for v, c in cascades.items():
        verdict = F.when(F.col("rule").isNotNull() & c.listed(F.col("rule")), F.lit(v)).otherwise(verdict)
    return judged.withColumn("verdict", verdict)
