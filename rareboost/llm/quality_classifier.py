"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its features: words, 3- and 4-grams
of code points (a space at either end marks the edge of a word), and a mark for
each word that repeats its predecessor. Features are hashed to ``BUCKETS``
rows. A softmax over two classes follows; numpy trains vectors and output
together by stochastic gradient descent.

Only training looks at labels, and on a bounded sample: the ``TRAIN_ROWS``
labelled documents with the least hash of their id, held-out ids excluded. As
the output is linear in the mean, scoring needs one number per bucket: a table
of 1 MB goes to the tasks and every whole text is scored in one narrow pass.

Edge cases: null and empty texts score by the bias alone; labels other than 0
and 1, null ids and ids without a document are not trained on; of documents that
share an id one is trained on; without any label every score is 0.5. Input
columns named like a result column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from rareboost.llm import textbytes as tb
from rareboost.llm.columns import hash56

BUCKETS, DIM = 1 << 17, 8
TRAIN_ROWS, STEPS, RATE, SEED = 4_000, 16_000, 4.0, 42
_U4 = np.uint32


@dataclass
class Model:
    """Logit of class 1: the mean of ``table`` over the features of a document, plus ``bias``."""

    table: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    """Whether an id is kept from training: crc32 of its text modulo 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Groups of (bucket of each feature, its position) over the texts in a row, and where each text starts."""
    joined = "".join(f" {t} " for t in texts)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), _U4)
    start = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])]).astype(np.int64)
    space = (chars == 0x20) | ((chars >= 0x09) & (chars <= 0x0D))
    chars = np.where(space, _U4(0x20), chars)
    found = []
    for n in (3, 4):
        m = len(chars) - n + 1
        # Inner characters are no spaces; texts begin and end with one, so no gram spans two texts.
        at = np.flatnonzero(~space[1 : 1 + m] & (~space[2 : 2 + m] if n == 4 else True))
        h = np.full(len(at), n * 0x9E3779B1 & 0xFFFFFFFF, _U4)
        for k in range(n):
            h = (h ^ chars[at + k]) * _U4(0x85EBCA6B)
            h ^= h >> _U4(15)
        found.append((h >> _U4(15), at))
    edge = np.diff(space.astype(np.int8))
    first, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    word = tb.spans_hash(chars.astype(np.uint64) + np.uint64(1), first, end)
    found.append(((word >> np.uint64(47)).astype(_U4), first))
    again = np.flatnonzero(word[1:] == word[:-1]) + 1
    again = again[np.searchsorted(start, first[again], "right") == np.searchsorted(start, first[again - 1], "right")]
    found.append((np.zeros(len(again), _U4), first[again]))
    return found, start


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    """Probability of class 1 for each text; does not depend on which texts share a call."""
    found, start = features(texts)
    total, n = np.zeros(start[-1]), np.zeros(start[-1])
    for bucket, at in found:
        total[at] += model.table[bucket]
        n[at] += 1
    mean = np.add.reduceat(total, start[:-1]) / np.maximum(1, np.add.reduceat(n, start[:-1]))
    return 1 / (1 + np.exp(-(mean + model.bias)))


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """About STEPS steps of stochastic gradient descent, each on one whole document, with a falling rate."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    docs = []
    for t in texts:
        bucket, n = np.unique(np.concatenate([b for b, _ in features([t])[0]]), return_counts=True)
        docs.append((bucket, (n / max(1, n.sum())).astype(np.float32)))
    epochs = math.ceil(STEPS / len(docs))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            bucket, share = docs[i]
            rows = vectors[bucket]
            hidden = share @ rows
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * np.float32(0.1) * p
            vectors[bucket] = rows - rate * np.outer(share, back)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, n_rows: int = TRAIN_ROWS, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[list[str], np.ndarray]:
    """At most ``n_rows`` labelled texts, chosen by the hash of their id, in that order."""
    wanted = F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key))
    known = labels.where(wanted).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("_y"))
    # Ids without a document must not use up the sample, so documents are asked first; this reads ids only.
    known = known.join(docs.select(key).distinct(), key, "left_semi")
    chosen = known.withColumn("_h", hash56(F.lit("train"), F.lit(SEED), F.col(key))).orderBy("_h", key).limit(n_rows)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(chosen), key)  # n_rows rows
    rows = rows.groupBy(key).agg(F.min("_h").alias("h"), F.min("_y").alias("y"), F.min("_t").alias("t")).toArrow()
    order = np.argsort(np.array(rows["h"], dtype=np.int64), kind="stable")
    texts, y = rows["t"].to_pylist(), np.array(rows["y"], dtype=np.int64)
    return [texts[i] for i in order], y[order]


def train(docs: DataFrame, labels: DataFrame, n_rows: int = TRAIN_ROWS) -> Model:
    texts, y = training_rows(docs, labels, n_rows)
    return fit(texts, y) if len(texts) else Model(np.zeros(BUCKETS), 0.0)


def score(docs: DataFrame, model: Model, *, text: str = "text", columns: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """``columns`` of the documents (all by default) with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    columns = docs.columns if columns is None else columns
    kept = [c for c in columns if c.lower() not in ("score", "predicted")]
    fields = {f.name: f for f in docs.schema}
    schema = T.StructType([*[fields[c] for c in kept], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = tb.utf8(batch.column(len(kept)))
            scores = [np.empty(0)]
            for a, b in tb.runs(offsets, 1 << 19):
                scores.append(score_texts(shared.value, [t or "" for t in batch.column(len(kept))[a:b].to_pylist()]))
            s = np.concatenate(scores)
            new = [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names=[f.name for f in schema])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_scanned")).mapInArrow(run, schema)
