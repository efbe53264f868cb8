"""Every stage of the pipeline on its own input, by brute force."""

import math

import pytest

import corpus_pipeline
from rareboost.llm.quality_classifier import held_out
from rareboost.session import stage
from tests.llm.brute import SPACE, components
from tests.llm.test_texts import judged


@pytest.fixture(scope="module")
def sf():
    """Large enough to learn from: the smallest tables have nine bad documents outside the held-out fold."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, sf):
    """Rows before and after every stage; the input has nulls, repeated rows and a source of its own."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "", "en", "odd", 0), (None, "no id here at all", "en", "odd", 17)], docs.schema)
    frames = [stage(docs.union(docs.where("doc_id % 50 = 7")).union(odd))]
    for _, step in corpus_pipeline.STAGES:
        frames.append(stage(step(spark, frames[-1], sf)))
    return frames


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_columns(steps):
    assert all(f.columns == steps[0].columns for f in steps[:-1])
    assert steps[-1].columns == [*steps[0].columns, "shard", "slot"]


def test_quality_keeps_good_held_out_documents(spark, steps, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    test = labels.where(held_out(labels["doc_id"]))
    kept = {r[0] for r in steps[1].select("doc_id").collect()}
    got = [(r["doc_id"] in kept) == bool(r["quality"]) for r in test.collect()]
    assert sum(got) >= 0.95 * len(got)


def test_one_document_of_each_group_stays(steps):
    before = rows(steps[1], "doc_id", "text")
    comp = components([r for r in before if r[0] is not None])
    want = {r for r in before if r[0] is not None and comp[r[0]][1] == r[0]}
    assert rows(steps[2], "doc_id", "text") == sorted([*want, *[r for r in before if r[0] is None]], key=str)


def test_contaminated_documents_go(spark, steps, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    before = rows(steps[2], "doc_id", "text")
    want = [r for r, j in zip(before, judged(before, items)) if not j[-1]]
    assert rows(steps[3], "doc_id", "text") == want


def test_mix_is_near_its_targets(steps):
    size = lambda t: len(SPACE.findall(t or ""))
    before, after = rows(steps[3], "source", "doc_id", "text"), rows(steps[4], "source", "doc_id", "text")
    total = lambda rs: sum(size(t) for *_, t in rs)
    largest = sum(max(size(t) for s, _, t in before if s == x) for x in {s for s, *_ in before})
    assert abs(total(after) - 1.5 * total(before)) <= largest
    assert set(after) <= set(before) and all(after.count(r) <= 2 * before.count(r) for r in set(after))


def test_shards_are_even(steps):
    n = steps[4].count()
    got = rows(steps[5], "shard", "slot")
    assert len(got) == n and len(set(got)) == n
    sizes = [sum(s == k for s, _ in got) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and max(slot for _, slot in got) == math.ceil(n / 16) - 1
    assert rows(steps[5], "doc_id", "text") == rows(steps[4], "doc_id", "text")


def test_working_names_of_the_caller_survive(spark):
    """Columns named like working columns pass through deduplication, decontamination and mixing unchanged."""
    from rareboost.llm import decontamination, mixing, neardup

    names = ["_id", "_hash", "_number", "_hit", "_found", "_src", "_none", "_text", "_row", "_scanned", "_0"]
    docs = [(i, f"word{i} " * (3 + i), "s", *[f"{n}-{i}" for n in names]) for i in range(6)]
    df = spark.createDataFrame([*docs, docs[0]], ["doc_id", "text", "source", *names])
    bench = spark.createDataFrame([("x", "some other words")], "item_id string, text string")
    assert sorted(map(tuple, neardup.deduplicated(df).select(df.columns).collect())) == docs
    for out in (decontamination.contamination(df, bench), mixing.mixed(df), mixing.draw(df)):
        assert set(map(tuple, out.select(df.columns).collect())) == set(docs)
