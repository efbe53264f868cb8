"""Centroids, fingerprints and token alignment against plain re-computations, and their edge cases."""

import hashlib
import math
import os
import re
import struct

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from rareboost.llm import alignment, centroids, fingerprints, tokenizers
from rareboost.llm.catalog import QUERIES
from tests.llm.brute import lower

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# -- centroids ---------------------------------------------------------------------------------------------------------


def lloyd(rows, k, rounds, dims, seed="3"):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    c = [list(v) for _, v in first]
    gap = lambda v, w: sum((x - y) ** 2 for x, y in zip(v, w))
    pick = lambda v: min((gap(v, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = [pick(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, pick(v)[1], pick(v)[0]) for i, v in kept], c


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_cluster_equals_plain_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(i % 3, 1, 4)]) for i in range(120)]
    rows += [(200 + i, rows[i % 2][1]) for i in range(40)] + [(3, rows[3][1]), (None, rows[5][1]), (None, None), (7, [1.0, None, 2.0, 3.0])]
    rows += [(300, [1.0]), (301, []), (302, [float("nan")] * 4), (303, [float("inf"), 0.0, 0.0, 0.0])]
    found = centroids.cluster(frame(spark, rows).repartition(5), k=5, rounds=6, dims=4)
    want, c = lloyd(rows, 5, 6, 4)
    assert order([tuple(r) for r in found.rows.collect()]) == order(want)
    assert found.centroids.tolist() == c
    assert found.inertia == [sum(d for _, o, d in want if o == j) for j in range(5)]


def test_few_equal_and_no_vectors(spark):
    found = centroids.cluster(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.5, 0.5])]), k=8, dims=2)
    assert len(found.centroids) == 3 and order([tuple(r) for r in found.rows.collect()]) == [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    assert centroids.cluster(frame(spark, []), dims=2).rows.collect() == []
    assert centroids.cluster(frame(spark, [(1, None)]), dims=2).rows.collect() == []


def test_other_columns_do_not_matter(spark):
    df = frame(spark, [(1, [0.5, 0.5]), (2, [1.5, 0.5])]).withColumn("cluster", F.lit("x")).withColumn("near", F.lit(1)).withColumn("v", F.lit(2))
    assert sorted(r["cluster"] for r in centroids.cluster(df, k=2, dims=2).rows.collect()) == [0, 1]


def test_components_beyond_64_bits_raise(spark):
    with pytest.raises(Exception, match="2\\^27"):
        centroids.cluster(frame(spark, [(1, [1e30, 0.0])]), dims=2)


def test_bounds_never_exceed_distances_and_skip_some():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-900, 900, (400, 8)), rng.integers(-3, 3, (100, 8)), np.zeros((4, 8), int)])
    c = np.concatenate([v[:6], rng.integers(-10**6, 10**6, (2, 8))])
    pivots = centroids.Pivots.among(v[:200], 6)
    lower_ = pivots.bounds(pivots.distances(v), pivots.distances(c))
    exact = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (lower_ <= exact).all()
    label, best, checked = centroids.nearest(v, pivots.distances(v), c, pivots)
    assert (label == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert checked < exact.size


# -- fingerprints ------------------------------------------------------------------------------------------------------


def signed(h):
    return struct.unpack("<q", struct.pack("<Q", h))[0]


def plain_print(text):
    words = SPACE.findall(lower(text))
    if not words:
        return None
    word = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    hashes = []
    for i in range(len(words) - 4):
        h = 42
        for x in word[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", x), h)
        hashes.append(signed(h))
    if len(words) < 5:
        hashes = [signed(xxhash.xxh64_intdigest(" ".join(words).encode(), 42))]
    least = {}
    for h in hashes:
        b = (h >> 56) + 128
        least[b] = min(least.get(b, h), h)
    starts, steps = fingerprints.probes()
    out = []
    for i in range(256):
        j, t = i, 0
        while j not in least:
            j, t = (steps[i] * t + starts[i]) % 256, t + 1
        out.append(least[j] % 16)
    return out


def plain_like(a, b):
    if a is None or b is None:
        return float(a is None and b is None)
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 16) / (1 - 1 / 16))


def hexed(p):
    return "".join(f"{x:x}" for x in p or [])


def plain_rows(docs):
    """Rows of the query for distinct (id, text)."""
    docs = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), signed(xxhash.xxh64_intdigest((d[1] or "").encode(), 42))))
    out = []
    for k, (i, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, new, nxt = plain_print(text), plain_print(edited), plain_print(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(own), hexed(new), plain_like(own, new), plain_like(own, nxt)))
    return out


def prints(df):
    out = fingerprints.with_next(df).select(
        "doc_id", F.char_length("text"), F.sha2("edited", 256), fingerprints.as_text(F.col("print")), fingerprints.as_text(F.col("edited_print")),
        fingerprints.likeness(F.col("print"), F.col("edited_print")), fingerprints.likeness(F.col("print"), F.col("next_print")),
    )
    return [tuple(r) for r in out.collect()]


def close(mine, want):
    mine, want = order(mine), order(want)
    assert [r[:5] for r in mine] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in mine], [r[5:] for r in want], atol=1e-12)


def test_query_equals_plain_fingerprints(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    mine = [tuple(r) for r in QUERIES["op12_fingerprint_one_permutation"](spark, sf).collect()]
    close(mine, plain_rows(list(docs[["doc_id", "text"]].itertuples(index=False, name=None))))


def test_fingerprints_of_odd_documents(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = [(5, "one two"), (4, None), (3, ""), (2, "  \t "), (1, long), (0, "É\U0001F600x ünï one two three four five"), (None, "no id at all, five words"), (9, "One TWO")]
    df = spark.createDataFrame(docs + docs[:1] * 3 + [(5, "another text of five")], "doc_id long, text string")
    df = df.withColumn("_text", F.lit("x")).withColumn("_rows", F.lit(3)).withColumn("print", F.lit(1)).repartition(4)
    want = plain_rows(docs + [(5, "another text of five")])
    repeated = [r for r in want if r[0] == 5 and r[1] == 7]
    close(prints(df), want + repeated * 3)
    assert len({r[3] for r in want if r[0] in (5, 9) and r[1] == 7}) == 1


def test_fingerprints_of_one_and_no_document(spark):
    one = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    close(prints(one), plain_rows([(1, "a b c d e f g h i")]))
    assert prints(one.limit(0)) == []


def test_likeness_is_near_the_similarity(spark):
    words = [f"w{i}" for i in range(900)]
    docs = [(k, " ".join(words[: 900 - 90 * k] + [f"x{k}-{i}" for i in range(90 * k)])) for k in range(6)]
    df = fingerprints.fingerprint(spark.createDataFrame(docs, "doc_id long, t string"), "t", "p").select("doc_id", "p")
    base = df.where("doc_id = 0").select(F.col("p").alias("q"))
    rows = df.join(base).select("doc_id", fingerprints.likeness(F.col("p"), F.col("q")).alias("s")).collect()
    for r in rows:
        same, new = 896 - 90 * r["doc_id"], 90 * r["doc_id"]
        assert abs(r["s"] - same / (896 + new)) < 0.12


# -- alignment ---------------------------------------------------------------------------------------------------------


def plain_alignment(docs):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(os.path.join(tokenizers.FOLDER, tokenizers.FILE_A))
    one.encode_special_tokens = True
    two = SentencePieceProcessor(model_file=os.path.join(tokenizers.FOLDER, tokenizers.FILE_B))
    letters = tokenizers._byte_letters()
    bytes_a = lambda i: bytes(letters[c] for c in one.id_to_token(i))
    bytes_b = lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
    out, counts = [], {}
    for key, text in docs:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        if text and (b"".join(map(bytes_a, a)) != (" " + text).encode() or b"".join(map(bytes_b, b)) != (" " + text).encode()):
            a, b = [], []
        end_a, end_b = np.cumsum([len(bytes_a(i)) for i in a]).tolist(), np.cumsum([len(bytes_b(i)) for i in b]).tolist()
        both = sorted(set(end_a) & set(end_b))
        links = [(a[end_a.index(e)], b[end_b.index(e)]) for e in both]
        groups = [
            ",".join(str(x) for x, e in zip(a, end_a) if lo < e <= hi) + "|" + ",".join(str(x) for x, e in zip(b, end_b) if lo < e <= hi)
            for lo, hi in zip([0, *both], both)
        ]
        for link in links:
            counts[link] = counts.get(link, 0) + 1
        out.append((key, len(a), len(b), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [
        (key, na, nb, ng, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha)
        for key, na, nb, ng, links, sha in out
    ]


def alignment_rows(df):
    found = alignment.aligned(df)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    out = alignment.scored(found.select("doc_id", "n_a", "n_b", "n_groups", digest.alias("sha"), "links"))
    return [tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha").collect()]


def test_query_equals_plain_alignment(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "text"]]
    docs = docs[docs.text.str.len() < 4000]
    df = spark.createDataFrame(docs).repartition(3)
    assert order(alignment_rows(df)) == order(plain_alignment(list(docs.itertuples(index=False, name=None))))


def test_alignment_of_odd_texts(spark, monkeypatch):
    texts = [
        None, "", " ", "a", "<|endoftext|> and <s> </s> <unk> <0x41>", "Ünïcödé — „Wörter“ 12345 €", "日本語のテキスト и русский текст ไทย",
        "emoji \U0001F600\U0001F468‍\U0001F469 end", "tabs\tand\nlines\r\n\n  spaces   end  ", " hard spaces​", "▁literal ▁ mark", "x" * 3000,
        " leading", "İstanbul ǅ ﬁ", "same text", "same text",
    ]
    docs = list(enumerate(texts)) + [(None, "same text")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("links", F.lit(1)).withColumn("_row", F.lit("x")).repartition(4)
    want = plain_alignment(docs)
    assert order(alignment_rows(df)) == order(want)
    # The same with hardly any broadcast pairs.
    monkeypatch.setattr(alignment, "HOT_PAIRS", 2)
    assert order(alignment_rows(df)) == order(want)
    assert alignment_rows(df.limit(0)) == []


def test_groups_of_any_two_cuts():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(1, 60))
        cuts = [sorted({n, *rng.choice(np.arange(1, n + 1), int(rng.integers(0, n)), replace=False).tolist()}) for _ in range(2)]
        if rng.random() < 0.3:
            cuts[1] = cuts[0]
        both = sorted(set(cuts[0]) & set(cuts[1]))
        ends = []
        for i0, i1, j0, j1, single in alignment.group_runs(*cuts):
            ends += zip(range(i0 + 1, i1 + 1), range(j0 + 1, j1 + 1)) if single else [(i1, j1)]
        assert ends == [(cuts[0].index(e) + 1, cuts[1].index(e) + 1) for e in both]
    assert alignment.group_runs([], []) == []


def test_both_forms_of_the_byte_tokenizer_agree(sf):
    a = tokenizers.load("byte", os.path.join(tokenizers.FOLDER, tokenizers.FILE_A))
    for text in pd.read_parquet(f"{sf}/documents.parquet").text:
        assert a._own.encode(" " + text, add_special_tokens=False).ids == a._ranks.encode_ordinary(" " + text) or not tokenizers._PLAIN.fullmatch(text)
