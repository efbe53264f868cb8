"""Near-duplicates against a comparison of every pair that shares a shingle."""

import random

import numpy as np
import pytest

from rareboost.llm import neardup, setsketch
from rareboost.llm.components import connected_components
from tests.llm.brute import components, shingles


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()}


def expected(rows):
    return {d: (n, c, d == c) for d, (n, c) in components(rows).items()}


def variants(seed=5):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    passage = [word() for _ in range(60)]
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.randrange(80, 300))]
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [" ".join(passage + [word() for _ in range(rng.randrange(10, 120))]) for _ in range(60)]
    chain = [word() for _ in range(200)]
    for _ in range(15):  # each is near the one before and far from the first
        chain = chain[6:] + [word() for _ in range(6)]
        rows.append(" ".join(chain))
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_equals_all_pairs(spark):
    rows = variants()
    assert run(spark, rows) == expected(rows)


def test_equals_all_pairs_on_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(spark, rows) == expected(rows)


def test_edges(spark):
    long_text = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B"), (6, "a b c d e"), (7, "a b c d e f"), (9, long_text), (8, long_text + " end")]
    assert run(spark, rows) == expected(rows)
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    got = sorted(tuple(r) for r in neardup.near_duplicates(df).drop("text_hash").collect() if r["doc_id"] is not None)
    assert got == [(1, 1, 1, True)] * 2
    assert [tuple(r) for r in neardup.near_duplicates(df).drop("text_hash").where("doc_id is null").collect()] == [(None, 1, None, True)]
    assert run(spark, []) == {}


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (7, "a B c d e f", "y"), (7, "other words", "z"), (None, "a b c d e f", "n"), (9, None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _hash2 string")
    got = neardup.deduplicated(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[4], rows[5]], key=str)


def test_blocks_compare_across(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rows = variants(9)
    assert run(spark, rows) == expected(rows)


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (900, 300, 300))
    x, y = np.concatenate([a, b]), np.concatenate([a, c])
    assert (setsketch.merge(setsketch.registers(a), setsketch.registers(b)) == setsketch.registers(x)).all()
    n = np.array([1200.0])
    j, _ = setsketch.estimate(setsketch.registers(x)[None], setsketch.registers(y)[None], n, n)
    assert abs(j[0] - 900 / 1500) < 0.15


@pytest.mark.parametrize("links", [[(2, 1), (3, 2), (4, 3)], [(5, 9), (9, 7), (1, 2)], [], [(3, 3)], [(i + 1, i) for i in range(60)]])
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {n: n for link in links for n in link}
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {n: c for n, c in parent.items() if n != c}


def test_shingles_are_words():
    assert shingles("A b  C") == {("a", "b", "c")}
