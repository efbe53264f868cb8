"""Alignment of two tokenizers' tokens, by diagonal run skipping.

Both token sequences of a text are reduced to arrays of byte offsets at which
tokens end. Where both end, a group ends. While the two run one to one, position
i of A meets position i + shift of B, so equal stretches of the arrays are
compared whole, with lengths that double as long as they agree (exponential
probing), and jumped; the length of the agreeing stretch is then found by
halving. Where they differ, the side that lags steps forward until both end
together again; that irregular group gives the new shift.

A text's tokens are found and aligned in one narrow pass, in slices of bounded
size. Its links - the last tokens of A and B in every group - are kept as
distinct id pairs with counts. Corpus-wide counts per pair come from a grouped
sum of those. They return to the documents in two ways: pairs that occur in many
documents, of which there are at most ``HOT_PAIRS`` by their definition, are
broadcast, all others are joined by their ids.

Edge cases: texts that are null, empty or not reproduced by the bytes of either
side's tokens have no tokens, no groups and no links. Every row, repeated or with
a null id, is a text of its own and counts in the pair counts. Other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from rareboost.llm import tokenizers
from rareboost.session import stage

#: Most id pairs that are broadcast: those in at least 1/HOT_PAIRS of all (document, pair) rows.
HOT_PAIRS = 4096
#: Characters of text that are held with their tokens at a time.
_SLICE = 1 << 20


def group_runs(a: list[int], b: list[int]) -> list[tuple[int, int, int, int, bool]]:
    """Stretches ``(from, to, from, to, one to one)`` of A and B tokens; both lists of byte ends rise and end alike.

    Every token of a one-to-one stretch is a group with its opposite; any other stretch is one group.
    """
    out: list[tuple[int, int, int, int, bool]] = []
    i = j = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        start, shift, step = i, j - i, 1
        # Jump the one-to-one stretch that starts here: longer and longer, then the rest by halving.
        while i < n and a[i : i + step] == b[i + shift : i + shift + step]:
            i += step
            step *= 2
        i = min(i, n)
        while step > 1 and i < n:
            step //= 2
            if a[i : i + step] == b[i + shift : i + shift + step]:
                i = min(i + step, n)
        if i > start:
            out.append((start, i, start + shift, i + shift, True))
            j = i + shift
        if i >= n or j >= m:
            break
        # An irregular group: the side whose token ends first goes on.
        i0, j0 = i, j
        while a[i] != b[j]:
            if a[i] < b[j]:
                i += 1
            else:
                j += 1
        i, j = i + 1, j + 1
        out.append((i0, i, j0, j, False))
    return out


class Aligner:
    """Tokens and groups of texts under one pair of tokenizers."""

    def __init__(self, folder: str, file_a: str, file_b: str) -> None:
        self.a = tokenizers.load("byte", os.path.join(folder, file_a))
        self.b = tokenizers.load("piece", os.path.join(folder, file_b))
        self._size_a, self._size_b = (np.array([len(t) for t in x.tokens], np.int64) for x in (self.a, self.b))
        self._text_a = [str(i) for i in range(len(self.a.tokens))]
        self._text_b = [str(i) for i in range(len(self.b.tokens))]

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of A and B; none unless the bytes of both spell a space and the text."""
        if not text:
            return [], []
        a, b = self.a.ids(" " + text), self.b.ids(text)
        spelled = (" " + text).encode("utf-8", "surrogatepass")
        if b"".join(map(self.a.tokens.__getitem__, a)) != spelled or b"".join(map(self.b.tokens.__getitem__, b)) != spelled:
            return [], []
        return a, b

    def align(self, text: str | None) -> tuple[int, int, int, str, tuple[np.ndarray, np.ndarray]]:
        """Numbers of A tokens, B tokens and groups, the groups as text, and the linked id pairs (A in the upper half) with counts."""
        a, b = self.tokens(text)
        ends_a, ends_b = self._size_a[np.array(a, np.int64)].cumsum(), self._size_b[np.array(b, np.int64)].cumsum()
        runs = group_runs(ends_a.tolist(), ends_b.tolist())
        say_a, say_b = list(map(self._text_a.__getitem__, a)), list(map(self._text_b.__getitem__, b))
        # What each group says and its last tokens, side by side; whole stretches at a time.
        of_a: list[str] = []
        of_b: list[str] = []
        last_a: list[int] = []
        last_b: list[int] = []
        for i0, i1, j0, j1, single in runs:
            if single:
                of_a += say_a[i0:i1]
                of_b += say_b[j0:j1]
                last_a += a[i0:i1]
                last_b += b[j0:j1]
            else:
                of_a.append(",".join(say_a[i0:i1]))
                of_b.append(",".join(say_b[j0:j1]))
                last_a.append(a[i1 - 1])
                last_b.append(b[j1 - 1])
        groups = ";".join(map("|".join, zip(of_a, of_b)))
        links = np.unique(np.array(last_a, np.int64) << 32 | np.array(last_b, np.int64), return_counts=True)
        return len(a), len(b), len(of_a), groups, links


_LINK = T.StructType([T.StructField("a_id", T.IntegerType()), T.StructField("b_id", T.IntegerType()), T.StructField("n", T.LongType())])


def _record(rows: list[tuple], keys: pa.Array, names: list[str]) -> pa.RecordBatch:
    pairs, n = (np.concatenate(x) for x in zip(*[r[4] for r in rows]))
    offsets = np.cumsum([0, *[len(r[4][0]) for r in rows]]).astype(np.int32)
    ids = [pa.array(x.astype(np.int32)) for x in (pairs >> 32, pairs & 0xFFFFFFFF)]
    items = pa.StructArray.from_arrays([*ids, pa.array(n.astype(np.int64))], names=["a_id", "b_id", "n"])
    counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
    text = pa.array([r[3] for r in rows], pa.string())
    return pa.RecordBatch.from_arrays([keys, *counts, text, pa.ListArray.from_arrays(pa.array(offsets), items)], names=names)


def aligned(
    df: DataFrame, *, key: str = "doc_id", text: str = "text",
    folder: str = tokenizers.FOLDER, file_a: str = tokenizers.FILE_A, file_b: str = tokenizers.FILE_B,
) -> DataFrame:
    """``key, n_a, n_b, n_groups, groups, links`` of every row.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``: ids of A, ids of B, group by group;
    ``links`` holds the id pairs whose tokens end together, with their number.
    """
    long = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups")]
    schema = T.StructType([df.schema[key], *long, T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(_LINK))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(folder, file_a, file_b)
        for batch in batches:
            rows, size, start = [], 0, 0
            for at, value in enumerate(batch.column(1)):
                rows.append(aligner.align(value.as_py()))
                size += len(rows[-1][3])
                if size >= _SLICE:
                    yield _record(rows, batch.column(0).slice(start, len(rows)), schema.names)
                    rows, size, start = [], 0, at + 1
            if rows:
                yield _record(rows, batch.column(0).slice(start, len(rows)), schema.names)

    return df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """``a_id, b_id, total, documents, best``: links per id pair, and whether no pair of the B id has more."""
    counted = stage(links.groupBy("a_id", "b_id").agg(F.sum("n").alias("total"), F.count("*").alias("documents")))
    # One row per B id: its vocabulary bounds what is broadcast.
    most = F.broadcast(counted.groupBy("b_id").agg(F.max("total").alias("most")))
    return counted.join(most, "b_id").select("a_id", "b_id", "total", "documents", (F.col("total") == F.col("most")).alias("best"))


def scored(rows: DataFrame) -> DataFrame:
    """Add ``n_links``, ``n_best`` and ``count_sum`` to a table with ``links``, which is staged first.

    ``n_best`` counts the links whose pair no pair of the same B id exceeds in the
    whole corpus; ``count_sum`` sums the corpus-wide counts over the links.
    """
    # The number is frozen by staging, so a recomputed task gives the same rows the same numbers.
    staged = stage(rows.withColumn("_row", F.monotonically_increasing_id()))
    links = staged.select("_row", F.inline("links"))
    pairs = pair_counts(links)
    floor = pairs.agg(F.floor(F.sum("documents") / HOT_PAIRS)).collect()[0][0] or 0
    # At most HOT_PAIRS pairs can exceed that share of the rows.
    hot = F.broadcast(pairs.where(F.col("documents") > floor).drop("documents"))
    cold = pairs.where(F.col("documents") <= floor).drop("documents")
    seen = links.join(hot, ["a_id", "b_id"], "left")
    rare = seen.where("total is null").drop("total", "best").join(cold, ["a_id", "b_id"])
    columns = ["_row", "n", "total", "best"]
    found = seen.where("total is not null").select(columns).unionByName(rare.select(columns))
    sums = found.groupBy("_row").agg(
        F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("total")).alias("count_sum"),
    )
    new = ["n_links", "n_best", "count_sum"]
    kept = [c for c in rows.columns if c not in new and c != "links"]
    return staged.join(sums, "_row", "left").select(*kept, *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in new])
