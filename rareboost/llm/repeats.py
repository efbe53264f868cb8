"""Removal of repeated passages by suffix arrays over the whole corpus.

A byte goes if a 50-byte string that covers it also starts in a document of a
smaller id. No machine holds the corpus, so the suffix array is cut into parts
that can be sorted alone: every 50-byte window belongs to the least hash of its
24-byte grams (its anchor), equal windows have equal anchors, and neighbouring
windows of one anchor travel as one segment.

1. Documents are packed into chunks of about 2 MB, staged once. Copies of the
   whole text of a smaller id go at once and take no part in what follows.
2. Which anchors occur in two documents is settled on 32-bit marks in hash
   buckets: every chunk sends each mark once, whatever the number of its copies,
   and gets one bit back. A mark shared by accident only makes work.
3. Segments of repeated anchors are dealt by anchor. Of equal segments all but
   the first document's are repeats throughout; one of each goes into an enhanced
   suffix array, whose common prefix intervals of 50 bytes or more give the
   maximal repeats and all their occurrences. An occurrence is removed if another
   is in a document of a smaller id.
4. Anchors of more than ``HOT`` segments are not sorted in one task: their
   windows are grouped by a 128-bit hash, with partial minima of the ids.
5. Removed ranges return to their chunk, which is read once more.

Edge cases: null texts are empty; texts under 50 bytes lose nothing; a null id
counts as larger than all others, and rows of one id never remove from each
other; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rareboost.llm import textbytes as tb
from rareboost.llm.suffix_array import SuffixArray
from rareboost.session import stage, unstage

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
CHUNK_BYTES, MARKS_PER_BUCKET, HOT = 2 << 20, 1_000_000, 20_000
#: Rows of segments that one suffix array takes, besides the rest of the last anchor.
SORTED_ROWS = 6_000
LAST = (1 << 63) - 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column(0).fill_null(LAST), np.int64)
        null = np.asarray(batch.column(0).is_null())
        data, offsets = tb.utf8(batch.column(1))
        for a, b in tb.runs(offsets, CHUNK_BYTES):
            # Texts travel compressed: they are dealt by chunk twice.
            text = pa.compress(data[offsets[a] : offsets[b]].tobytes(), codec="zstd", asbytes=True)
            blobs = [ids[a:b].tobytes(), null[a:b].tobytes(), (offsets[a : b + 1] - offsets[a]).tobytes(), text]
            size = pa.array([int(offsets[b] - offsets[a])], pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in blobs], size], ["ids", "nulls", "offsets", "data", "size"])


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, offsets = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["offsets"], np.int64)
    text = pa.decompress(row["data"], int(offsets[-1]), codec="zstd", asbytes=True) if offsets[-1] else b""
    return ids, offsets, np.frombuffer(text, np.uint8)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One chunk at a time, as a chunk is large."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: c[k].as_py() for n, c in zip(batch.schema.names, batch.columns)}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id and digest of the whole text of every document that can lose something."""
    for row in _rows(batches):
        ids, offsets, data = _unpack(row)
        doc = np.flatnonzero(np.diff(offsets) >= LENGTH)
        digest = [hashlib.blake2b(data[offsets[k] : offsets[k + 1]], digest_size=16).digest() for k in doc]
        chunk = pa.array(np.full(len(doc), row["chunk"], np.int64))
        yield pa.RecordBatch.from_arrays([chunk, pa.array(doc.astype(np.int32)), pa.array(ids[doc]), pa.array(digest, pa.binary())], ["chunk", "doc", "id", "digest"])


class Anchors:
    """For each window of a chunk, the place of its anchor; windows that span documents have none."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, copies: list[int] | None) -> None:
        self.hashes = tb.grams(data.astype(np.uint64) + np.uint64(1), GRAM)
        least = tb.sliding(self.hashes, SPAN, np.minimum)
        n = len(least)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
        takes_part = np.ones(len(offsets) - 1, bool)
        takes_part[copies or []] = False
        self.valid = (np.arange(n) + LENGTH <= offsets[1:][self.doc]) & takes_part[self.doc]
        self.least = least

    def marks(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes, and whether each is in documents of different ids."""
        # A new anchor begins where the least hash or the document changes.
        at = np.flatnonzero(self.valid)
        new = np.ones(len(at), bool)
        new[1:] = (self.least[at[1:]] != self.least[at[:-1]]) | (self.doc[at[1:]] != self.doc[at[:-1]])
        at = at[new]
        h, d = self.least[at], ids[self.doc[at]]
        order = np.lexsort([d, h])
        h, d = h[order], d[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        start = np.flatnonzero(first)
        if not len(start):
            return h, np.zeros(0, bool)
        return h[start], np.minimum.reduceat(d, start) < np.maximum.reduceat(d, start)


def _bucket(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def _send_marks(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, offsets, data = _unpack(row)
            h, several = Anchors(offsets, data, row["copies"]).marks(ids)
            cut = np.searchsorted(_bucket(h, n_buckets), np.arange(n_buckets + 1))
            some = [k for k in range(n_buckets) if cut[k] < cut[k + 1]] if n_buckets < len(h) else np.unique(_bucket(h, n_buckets)).tolist()
            marks = h.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()), pa.array([row["chunk"]] * len(some), pa.int64()),
                    pa.array([marks[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()),
                    pa.array([np.packbits(several[cut[k] : cut[k + 1]]).tobytes() for k in some], pa.binary()),
                ],
                ["bucket", "chunk", "marks", "several"],
            )

    return run


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which marks of a bucket occur twice; one bit per mark sent, in its order."""
    parts = [np.frombuffer(m, np.uint32) for m in pdf["marks"]]
    several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(p)) for s, p in zip(pdf["several"], parts)]).astype(bool)
    marks = np.concatenate(parts)
    order = np.argsort(marks, kind="stable")
    s = marks[order]
    twice = np.zeros(len(s), bool)
    twice[1:] = s[1:] == s[:-1]
    twice[:-1] |= twice[1:]
    again = np.empty(len(s), bool)
    again[order] = twice
    again |= several
    cut = np.cumsum([0, *[len(p) for p in parts]])
    return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "bits": [np.packbits(again[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])], "n": np.diff(cut).astype(np.int32)})


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring windows that share a repeated anchor."""
    for row in _rows(batches):
        ids, offsets, data = _unpack(row)
        anchors = Anchors(offsets, data, row["copies"])
        h, _ = anchors.marks(ids)
        bits = [np.unpackbits(np.frombuffer(b["bits"], np.uint8)) for b in sorted(row["answers"], key=lambda b: b["bucket"])]
        sizes = [int(b["n"]) for b in sorted(row["answers"], key=lambda b: b["bucket"])]
        again = np.concatenate([x[:n] for x, n in zip(bits, sizes)]).astype(bool)
        at = np.flatnonzero(anchors.valid)
        at = at[again[np.searchsorted(h, anchors.least[at])]]
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (anchors.least[at[1:]] != anchors.least[at[:-1]])
        # Longer runs of one anchor (a text that repeats itself) are cut, so that segments stay short.
        head = np.flatnonzero(new)
        since = np.arange(len(at)) - np.repeat(head, np.diff([*head, len(at)]))
        start = np.flatnonzero(since % SPAN == 0)
        begin, n = at[start], np.diff([*start, len(at)]) + LENGTH - 1
        _, where = tb.expand(begin, begin + n)
        values = pa.py_buffer(np.ascontiguousarray(data[where]))
        ends = pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        doc = anchors.doc[begin]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(anchors.least[begin].view(np.int64)), pa.array(ids[doc]), pa.array(np.full(len(begin), row["chunk"], np.int64)),
                pa.array(begin.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(begin), [None, ends, values]),
            ],
            ["key", "id", "chunk", "at", "bytes"],
        )


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole keys, in the order they come, about SORTED_ROWS rows at a time."""
    held: pa.Table | None = None
    for batch in batches:
        for a in range(0, batch.num_rows, SORTED_ROWS):
            table = pa.Table.from_batches([batch.slice(a, SORTED_ROWS)])
            held = table if held is None else pa.concat_tables([held, table])
            key = np.asarray(held["key"])
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if cut >= SORTED_ROWS // 2:
                yield held.slice(0, cut).combine_chunks()
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges to remove, packed by chunk; rows come sorted by anchor."""
    for t in _by_key(batches):
        key, ids = np.asarray(t["key"]), np.asarray(t["id"])
        chunk, at = np.asarray(t["chunk"]), np.asarray(t["at"]).astype(np.int64)
        column = t["bytes"].chunk(0)
        data, first = _binary(column)
        content = tb.spans_hash(data.astype(np.uint64) + np.uint64(1), first[:-1], first[1:])
        order = np.lexsort([ids, content, key])
        new = np.ones(len(order), bool)
        new[1:] = (content[order][1:] != content[order][:-1]) | (key[order][1:] != key[order][:-1])
        head = np.flatnonzero(new)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        least = ids[order][head]  # smallest id of each distinct segment
        late = ids > least[which]
        out = [np.stack([chunk[late], at[late], at[late] + np.diff(first)[late]], 1)]
        # One of each distinct segment, where its anchor has several.
        one = order[head]
        groups = np.unique(key[one], return_inverse=True)[1]
        several = np.bincount(groups)[groups] > 1
        pick = one[several]
        if len(pick):
            _, where = tb.expand(first[pick], first[pick + 1])
            begin = np.concatenate([[0], np.cumsum(np.diff(first)[pick])]).astype(np.int64)
            array = SuffixArray(data[where], begin, groups[several], LENGTH)
            owner = least[several]
            hi = []
            ids_of = owner[array.text]
            text, offset = [], []
            for depth, places in array.maximal_repeats(LENGTH):
                own = ids_of[places]
                gone = places[own > own.min()]
                text.append(array.text[gone])
                offset.append(array.at[gone])
                hi.append(np.full(len(gone), depth))
            if text:
                text, offset, depth = np.concatenate(text), np.concatenate(offset), np.concatenate(hi)
                # Ranges of a distinct segment hold for all its rows of the smallest id.
                mine = np.flatnonzero(~late)
                mine = mine[np.argsort(which[mine], kind="stable")]
                number = np.flatnonzero(several)[text]
                a, b = np.searchsorted(which[mine], number, "left"), np.searchsorted(which[mine], number, "right")
                k, m = tb.expand(a, b)
                row = mine[m]
                out.append(np.stack([chunk[row], at[row] + offset[k], at[row] + offset[k] + depth[k]], 1))
        yield _by_chunk(np.concatenate(out))


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _by_chunk(ranges: np.ndarray) -> pa.RecordBatch:
    """One row per chunk with its ranges as pairs of 32-bit numbers."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    chunks, start = np.unique(ranges[:, 0], return_index=True)
    blobs = [p[:, 1:].astype(np.int32).tobytes() for p in np.split(ranges, start[1:])] if len(chunks) else []
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "ranges"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a segment under two 64-bit hashes of its bytes."""
    for whole in batches:
        for k in range(0, whole.num_rows, 2_000):
            batch = whole.slice(k, 2_000)
            data, first = _binary(batch.column(4))
            text, begin = tb.expand(first[:-1], first[1:] - LENGTH + 1)
            values = data.astype(np.uint64) + np.uint64(1)
            one = tb.spans_hash(values, begin, begin + LENGTH)
            two = tb.spans_hash(values * values + np.uint64(7), begin, begin + LENGTH)
            at = np.asarray(batch.column(3)).astype(np.int64)[text] + begin - first[:-1][text]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column(1).take(pa.array(text)),
                    batch.column(2).take(pa.array(text)), pa.array(at.astype(np.int32)),
                ],
                ["one", "two", "id", "chunk", "at"],
            )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunk, at = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.int64)
        yield _by_chunk(np.stack([chunk, at, at + LENGTH], 1))


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each chunk without the removed bytes, digested."""
    for row in _rows(batches):
        ids, offsets, data = _unpack(row)
        null = np.frombuffer(row["nulls"], bool)
        edges = np.zeros(len(data) + 1, np.int64)
        for k in row["copies"] or []:
            edges[offsets[k]] += 1
            edges[offsets[k + 1]] -= 1
        for blob in row["ranges"] or []:
            pairs = np.frombuffer(blob, np.int32).reshape(-1, 2)
            np.add.at(edges, pairs[:, 0], 1)
            np.add.at(edges, pairs[:, 1], -1)
        gone = np.cumsum(edges[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begins[inner] = gone[inner]  # a run ends with its document
        removed, spans, kept, n = [], [], [], np.diff(offsets)
        for a, b in zip(offsets[:-1], offsets[1:]):
            out = gone[a:b]
            removed.append(int(out.sum()))
            spans.append(int(begins[a:b].sum()))
            kept.append(data[a:b][~out].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64(), mask=null), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary()),
            ],
            ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def _free(spark) -> None:
    """Let Spark delete the shuffle files of steps whose results are staged."""
    gc.collect()
    spark._jvm.System.gc()


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans and kept_sha256 of every row; ``with_text`` adds ``kept``, the remaining bytes."""
    spark = docs.sparkSession
    packed = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        _chunks, "ids binary, nulls binary, offsets binary, data binary, size long"
    )
    chunks = stage(packed.withColumn("chunk", F.monotonically_increasing_id()), "zstd")
    n_bytes = chunks.agg(F.sum("size")).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes * 2 // (SPAN + 1) // MARKS_PER_BUCKET)
    digests = chunks.select("chunk", "ids", "offsets", "data").mapInArrow(_digests, "chunk long, doc int, id long, digest binary")
    digests = stage(digests)
    first = digests.groupBy("digest").agg(F.min("id").alias("first"))
    late = digests.join(first, "digest").where("id > first")
    copies = stage(late.groupBy("chunk").agg(F.collect_list("doc").alias("copies")))
    unstage(digests)
    blobs = chunks.select("chunk", "ids", "offsets", "data").join(copies, "chunk", "left")
    marks = blobs.mapInArrow(_send_marks(n_buckets), "bucket int, chunk long, marks binary, several binary")
    answers = marks.groupBy("bucket").applyInPandas(_settle, "chunk long, bucket int, bits binary, n int")
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits", "n")).alias("answers"))
    by_chunk = stage(by_chunk.join(copies, "chunk", "left"))
    del marks, answers, packed, blobs
    _free(spark)
    segments = chunks.select("chunk", "ids", "offsets", "data").join(by_chunk, "chunk").mapInArrow(
        _segments, "key long, id long, chunk long, at int, bytes binary"
    )
    segments = stage(segments, "zstd")
    _free(spark)
    hot = stage(segments.groupBy("key").count().where(F.col("count") > HOT).select("key"))
    plain = segments
    ranges = []
    if not hot.isEmpty():
        plain = segments.join(hot, "key", "left_anti")
        windows = segments.join(hot, "key", "left_semi").select("key", "id", "chunk", "at", "bytes")
        windows = windows.mapInArrow(_windows, "one long, two long, id long, chunk long, at int")
        first = windows.groupBy("one", "two").agg(F.min("id").alias("least"))
        late = windows.join(first, ["one", "two"]).where("id > least").select("chunk", "at")
        ranges.append(late.mapInArrow(_pack, "chunk long, ranges binary"))
    ranges.append(plain.repartition("key").sortWithinPartitions("key").mapInArrow(_covered, "chunk long, ranges binary"))
    found = ranges[0] if len(ranges) == 1 else ranges[0].union(ranges[1])
    removed = stage(found.groupBy("chunk").agg(F.collect_list("ranges").alias("ranges")))
    for done in (by_chunk, segments, hot):
        unstage(done)
    del found, ranges, plain, segments, by_chunk, hot
    _free(spark)
    columns = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    marked = chunks.select("chunk").join(removed, "chunk", "left").join(copies, "chunk", "left")
    out = chunks.join(marked, "chunk").select("ids", "nulls", "offsets", "data", "ranges", "copies").mapInArrow(_results, columns)
    out = out.withColumnRenamed("id", key)
    return out if with_text else out.drop("kept")
