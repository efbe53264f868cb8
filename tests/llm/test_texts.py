"""Repeats, decontamination and the classifier against brute force and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from rareboost.llm import decontamination, quality_classifier, repeats, suffix_array, textbytes
from tests.llm.brute import lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- repeats --------------------------------------------------------------------------


def removed(rows):
    rows = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: (1 << 63) if i is None else i
    first = {}
    for i, b in rows:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, order(i)), order(i))
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < order(i):
                gone[p : p + 50] = b"\1" * 50
        spans = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    pieces = [text(rng.randrange(40, 160)) for _ in range(8)]
    rows = [(i, "".join(rng.choice([text(rng.randrange(5, 80)), rng.choice(pieces)]) for _ in range(rng.randrange(1, 7)))) for i in range(150)]
    rows += [(300, "a" * 400), (301, "a" * 120 + "b"), (302, "ab" * 100), (303, "ab" * 60 + "\0" * 60), (304, "\0" * 55), (305, "\0" * 56)]
    rows += [(400, None), (401, ""), (402, "x" * 49), (402, "x" * 49), (None, rows[0][1]), (None, "a" * 60), (7, rows[8][1]), (8, rows[8][1]), (8, rows[8][1])]
    rows += [(500, text(60_000)), (501, text(3000))]
    return rows + [(502, rows[-2][1][10_000:30_000] + rows[-1][1])]


@pytest.mark.parametrize(("hot", "chunk", "sorted_rows"), [(20_000, 2 << 20, 6000), (3, 4000, 50)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, chunk, sorted_rows):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = repeated_texts()
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(repeats, "SORTED_ROWS", sorted_rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_bytes string")
    got = sorted(map(tuple, repeats.remove_repeats(df).collect()), key=str)
    assert got == sorted(removed(rows), key=str)


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kept_bytes_are_the_rest(spark):
    df = spark.createDataFrame([(1, "p" * 60 + "q"), (2, "r" + "p" * 60)], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(df, with_text=True).collect()}
    assert got == {1: b"p" * 60 + b"q", 2: b"r"}


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(60)).encode() for _ in range(4)]
    want = set()
    places = {}
    for t, x in enumerate(texts):
        for i in range(60):
            for j in range(i + 5, 61):
                places.setdefault(x[i:j], []).append((t, i))
    for s, where in places.items():
        left = {texts[t][i - 1 : i] if i else (t, i) for t, i in where}
        right = {texts[t][i + len(s) : i + len(s) + 1] or (t, i) for t, i in where}
        if len(where) > 1 and len(left) > 1 and len(right) > 1:
            want.add((s, tuple(sorted(where))))
    assert {(s, tuple(where)) for s, where in suffix_array.repeats(texts, 5)} == want


# --- benchmark ------------------------------------------------------------------------


def judged(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text or ""))
        n = min(len(w), 13)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for d, text in docs:
        w = WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        named = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), named, bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_contamination_equals_brute_force(spark, block_words):
    rng = random.Random(7)
    words = lambda n: [f"W{rng.randrange(60)}" for _ in range(n)]
    items = [(i, " ".join(words(rng.randrange(13, 40)))) for i in range(20)] + [(90, "short Item"), (91, None), (92, "..."), (None, "é"), (10, "w1 w2 w1"), (90, " ".join(["same"] * 30))]
    docs = []
    for i in range(120):
        w = words(rng.randrange(0, 60))
        source = rng.choice(items)[1]
        if source:
            part = source.lower().split()
            a = rng.randrange(len(part))
            w[5:5] = part[a : a + rng.randrange(1, 30)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(500, None), (501, ""), (502, "short item"), (502, "SHORT-item x É"), (None, items[0][1]), (503, "same " * 40_000), (504, "w1 w2 w1 w2 w1")]
    schema = "doc_id long, text string, n_hit string"
    df = spark.createDataFrame([(*d, "x") for d in docs], schema)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(df, bench, columns=["doc_id", "n_hit"], block_words=block_words)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(judged(docs, items), key=str)
    whole = decontamination.contamination(df, bench)
    assert whole.columns == ["doc_id", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"] and whole.count() == len(docs)
    assert decontamination.contamination(df, bench.where("false")).where("n_hit > 0 or contaminated").count() == 0
    assert decontamination.contamination(df.where("false"), bench).count() == 0


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 1 << 62, 13, dtype=np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([rng.integers(0, 1 << 62, n, dtype=np.uint64), shared, rng.integers(0, 1 << 62, n, dtype=np.uint64)]) for n in rng.integers(0, 30, 2))
        marks = [set(textbytes.grams(x, 5)[decontamination.fingerprints(x, np.array([0, len(x)]))].tolist()) for x in (a, b)]
        assert marks[0] & marks[1] & set(textbytes.grams(shared, 5).tolist())


# --- classifier -----------------------------------------------------------------------


def test_held_out_labels_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_classifier.score(docs, quality_classifier.train(docs, labels), columns=["doc_id"])
    test = scored.where(quality_classifier.held_out(scored["doc_id"])).join(labels, "doc_id").toPandas()
    assert (test["predicted"] == test["quality"]).mean() > 0.97
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in test["doc_id"])


def test_scores_equal_a_plain_mean(spark):
    rng = np.random.default_rng(3)
    model = quality_classifier.Model(rng.normal(size=quality_classifier.BUCKETS), 0.25)
    texts = [None, "", " ", "a", "ab cd", "é𝄞 é𝄞\n\tx", "same same same", "long " * 40_000, "tail "]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    got = quality_classifier.score(df, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    for r in got.collect():
        values = np.concatenate([model.table[b] for b, _ in quality_classifier.features([r["text"] or ""])[0]])
        mean = values.mean() if len(values) else 0.0
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(mean + 0.25)))) and r["predicted"] == int(r["score"] >= 0.3)


def test_features_do_not_cross_texts():
    one = [quality_classifier.features([t])[0] for t in ("ab ab", "ab x")]
    both = quality_classifier.features(["ab ab", "ab x"])[0]
    for k, (bucket, _) in enumerate(both):
        assert sorted(bucket.tolist()) == sorted([*one[0][k][0].tolist(), *one[1][k][0].tolist()])
    assert len(both[3][0]) == 1


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, None), (None, "x"), (4, "held out")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 7, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels)
    assert [r["score"] for r in quality_classifier.score(docs, model).collect()] == [0.5] * 4
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    texts, y = quality_classifier.training_rows(docs.union(docs), labels)
    assert sorted(zip(texts, y.tolist())) == sorted([(t, l) for i, t, l in ((0, "a b", 1), (1, "", 0)) if zlib.crc32(str(i).encode()) % 5])
    assert quality_classifier.score(docs.where("false"), model).count() == 0
