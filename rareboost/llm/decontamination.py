"""Benchmark decontamination by winnowing.

Words are runs of letters and digits, A-Z lower-cased. Of every window of 13
words the least hash of its 5-word grams is a fingerprint, on both sides; a span
of 13 words that a document shares with an item therefore shares a fingerprint
at the same place. Fingerprints of the items are joined to those of the
documents, and each hit is extended word by word in both directions; 13 words or
more in a row are an occurrence. Items of fewer words are one window each and
are looked up by the hash of all their words.

The benchmark is worked off in blocks of at most ``block_words`` words, each
held by every task; further blocks are further narrow passes over the documents,
so neither side is shuffled and no document leaves its task. Equality of words
is equality of 64-bit hashes.

Edge cases: null and empty texts have no words and no hits; items without words
match nothing; items of one id count once; a null item id is named ``null``; an
empty benchmark hits nothing. Input columns named like a result column are
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from rareboost.llm import textbytes as tb

WINDOW, GRAM = 13, 5
BLOCK_WORDS = 2_000_000
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
])
STATE = [T.StructField("_hit", T.BinaryType()), T.StructField("_found", T.ArrayType(T.StringType()))]


class Block:
    """Words and fingerprints of some items of the benchmark."""

    def __init__(self, ids: list[str], item_words: list[np.ndarray]) -> None:
        self.ids = ids
        self.words = np.concatenate(item_words) if item_words else np.empty(0, np.uint64)
        lengths = np.array([len(w) for w in item_words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.item_of = np.repeat(np.arange(len(ids)), lengths)
        places = fingerprints(self.words, self.first)
        marks = tb.grams(self.words, GRAM)[places] if len(places) else np.empty(0, np.uint64)
        order = np.argsort(marks, kind="stable")
        self.places, self.marks = places[order], tb.Lookup(marks[order])
        self.short: list[tuple[int, tb.Lookup, np.ndarray]] = []
        for n in sorted({int(x) for x in lengths if 0 < x < WINDOW}):
            items = np.flatnonzero(lengths == n)
            start = self.first[items]
            whole = tb.grams(self.words, n)[start]
            order = np.argsort(whole, kind="stable")
            self.short.append((n, tb.Lookup(whole[order]), items[order]))

    def scan(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hit mark of every word; pairs of document and item with an occurrence."""
        doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        edges = np.zeros(len(words) + 1, np.int64)
        docs, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        places = fingerprints(words, first)
        if len(places) and len(self.places):
            at, lo, hi = self.marks.find(tb.grams(words, GRAM)[places])
            which, mark = tb.expand(lo, hi)
            here, there = places[at][which], self.places[mark]
            for a in range(0, len(here), 50_000):
                self._extend(words, first, doc_of, here[a : a + 50_000], there[a : a + 50_000], edges, docs, items)
        for n, lookup, its in self.short:
            whole = tb.grams(words, n)
            at, lo, hi = lookup.find(whole)
            inside = doc_of[at] == doc_of[at + n - 1]
            at, lo, hi = at[inside], lo[inside], hi[inside]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + n, -1)
            which, mark = tb.expand(lo, hi)
            docs.append(doc_of[at][which])
            items.append(its[mark])
        pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)], 1), axis=0)
        return np.cumsum(edges[:-1]) > 0, pairs[:, 0], pairs[:, 1]

    def _extend(self, words, first, doc_of, here, there, edges, docs, items) -> None:
        """Grow each shared gram to at most 13 words from its first and 8 before it."""
        doc, item = doc_of[here], self.item_of[there]
        step = np.arange(GRAM - WINDOW, WINDOW)
        i, j = here[:, None] + step, there[:, None] + step
        inside = (i >= first[doc][:, None]) & (i < first[doc + 1][:, None]) & (j >= self.first[item][:, None]) & (j < self.first[item + 1][:, None])
        same = inside & (words[np.clip(i, 0, len(words) - 1)] == self.words[np.clip(j, 0, len(self.words) - 1)])
        back = WINDOW - GRAM
        left = np.cumprod(same[:, :back][:, ::-1], 1).sum(1)
        right = np.cumprod(same[:, back:], 1).sum(1)
        whole = (left + right >= WINDOW) & (right >= GRAM)
        np.add.at(edges, (here - left)[whole], 1)
        np.add.at(edges, (here + right)[whole], -1)
        docs.append(doc[whole])
        items.append(item[whole])


def fingerprints(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Word positions of the winnowed grams of texts of at least one window."""
    if len(words) < WINDOW:
        return np.empty(0, np.int64)
    end = np.repeat(first[1:], np.diff(first))
    return tb.winnow(tb.grams(words, GRAM), WINDOW - GRAM + 1, (np.arange(len(words)) + WINDOW <= end))


def item_words(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """Item ids with the hashes of their words, made by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.utf8(batch.column(1))
            hashes, first = tb.word_hashes(data, offsets, tb.ALNUM)
            blobs = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(blobs, pa.binary())], ["item", "words"])

    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    return named.mapInArrow(run, "item string, words binary")


def blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, one at the driver at a time."""
    ids: list[str] = []
    held: list[np.ndarray] = []
    n = 0
    for row in item_words(benchmark, item, text).toLocalIterator():
        w = np.frombuffer(row["words"], np.uint64)
        if held and n + len(w) > block_words:
            yield Block(ids, held)
            ids, held, n = [], [], 0
        ids.append(row["item"])
        held.append(w)
        n += len(w)
    yield Block(ids, held)


def _pass(block, text_at: int, hit_at: int | None, last: bool, keep: list[int], names: list[str]) -> Callable:
    """One block against a batch of documents; the last pass turns marks into counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value
        for batch in batches:
            data, offsets = tb.utf8(batch.column(text_at))
            hits, found = [], []
            for a, b in tb.runs(offsets):
                part = offsets[a : b + 1] - offsets[a]
                words, first = tb.word_hashes(data[offsets[a] : offsets[b]], part, tb.ALNUM)
                hit, docs, items = known.scan(words, first)
                hits += [hit[x:y] for x, y in zip(first[:-1], first[1:])]
                cut = np.searchsorted(docs, np.arange(b - a + 1))
                found += [{known.ids[i] for i in items[x:y]} for x, y in zip(cut[:-1], cut[1:])]
            if hit_at is not None:
                earlier, earlier_found = batch.column(hit_at).to_pylist(), batch.column(hit_at + 1).to_pylist()
                hits = [h | np.unpackbits(np.frombuffer(e, np.uint8), count=len(h)).astype(bool) for h, e in zip(hits, earlier)]
                found = [f | set(e) for f, e in zip(found, earlier_found)]
            if last:
                n_words, n_hit = [len(h) for h in hits], [int(h.sum()) for h in hits]
                new = [
                    pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(f) for f in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found], pa.string()),
                    pa.array([h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words)], pa.bool_()),
                ]
            else:
                new = [pa.array([np.packbits(h).tobytes() for h in hits], pa.binary()), pa.array([sorted(f) for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *new], names=names)

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", columns: list[str] | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``columns`` of the documents (all by default) with n_words, n_hit, n_items, items_sha256 and contaminated."""
    columns = docs.columns if columns is None else columns
    taken = {f.name.lower() for f in RESULT}
    kept = [c for c in columns if c.lower() not in taken]
    # The caller's columns travel under numbers and the text last, so that working columns never meet them.
    fields = [T.StructField(f"_{k}", docs.schema[c].dataType) for k, c in enumerate(kept)]
    out = docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(kept)], F.col(f"`{text}`").alias("_scanned"))
    spark = docs.sparkSession
    todo = list(_shared(spark, blocks(benchmark, item, text, block_words)))
    n = len(kept)
    for k, block in enumerate(todo):
        last = k == len(todo) - 1
        keep = list(range(n if last else n + 1))
        added = list(RESULT) if last else [T.StructField("_scanned", T.StringType()), *STATE]
        schema = T.StructType([*fields, *added])
        out = out.mapInArrow(_pass(block, n, n + 1 if k else None, last, keep, [f.name for f in schema]), schema)
    return out.toDF(*kept, *[f.name for f in RESULT])


def _shared(spark, found: Iterator[Block]) -> Iterator:
    for block in found:
        yield spark.sparkContext.broadcast(block)  # bounded by block_words
