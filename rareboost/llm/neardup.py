"""Near-duplicate documents: SetSketch bands, likelihood, exact check, components.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; with fewer
words, all words as one shingle), as 64-bit hashes. Documents of equal sets form
one class, and only classes are compared:

1. Registers of each class are banded; in every band bucket the smallest and the
   largest class are hubs, and each member is paired with both.
2. Pairs whose registers make a similarity of 0.75 or more credible are ranked
   by estimated similarity, and each class is checked against its best hub on
   the full sets.
3. Buckets whose members are then still in several components are compared in
   full, in blocks: pairs across components are judged by their registers, and
   the credible ones checked on full sets until the components are joined or all
   are compared. So a hub that fails its bucket loses no link between others.
   Pairs never leave a task; only links do, and at most one for each class.

Links decide components; ``component_id`` is the smallest id reachable.

Edge cases: texts that are null, empty or without words have no shingles, link
with nothing and are kept; a null id links with nothing, has no component and is
kept; repeated rows are copies of each other under one id; an empty table gives
no rows. Rows of one id but different texts are judged each by its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rareboost.llm import setsketch as ss
from rareboost.llm import textbytes as tb
from rareboost.llm.components import connected_components
from rareboost.llm.columns import ROW, field, packed, unpacked
from rareboost.session import stage, unstage

SHINGLE, BLOCK = 5, 1024
SKETCH = "id long, n long, cls binary, regs binary, text_hash long"
#: Log-likelihood that 0.75 may fall behind the best similarity before a pair is dropped.
SLACK = 10.0
#: Estimated similarity from which a hub is taken for sure to link (it is checked all the same).
SURE = 0.85
#: Equal registers without which the likelihood of a pair is not worked out: at 0.75 it has 96, give or take 5.
FEWEST_EQUAL = 60


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first = tb.word_hashes(data, offsets, ~tb.SPACE)
    grams = tb.grams(words, SHINGLE)
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE))
    whole = dict(zip(few.tolist(), tb.spans_hash(words, first[few], first[few + 1]))) if len(few) else {}
    out = []
    for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        else:
            out.append(np.array([whole[k]], np.uint64) if k in whole else np.empty(0, np.uint64))
    return out


def _class(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = tb.utf8(column)
    for a, b in tb.runs(offsets):
        yield from shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, cls, regs = [], [], []
        for s in _sets(batch.column(1)):
            n.append(len(s))
            cls.append(_class(s) if len(s) else None)
            regs.append(ss.registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(regs, pa.binary()), batch.column(2)], ["id", "n", "cls", "regs", "text_hash"]
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            keys = ss.band_keys(_regs(part.column(1)))
            which = pa.array(np.repeat(np.arange(part.num_rows), ss.BANDS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel(), pa.int64()), pa.array(np.tile(np.arange(ss.BANDS, dtype=np.int32), part.num_rows)), part.column(0).take(which), part.column(2).take(which)],
                ["band", "number", "cls", "comp"],
            )


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, ss.REGISTERS)


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Credible pairs with their estimated similarity."""
    for batch in batches:
        if batch.num_rows:
            n_a, n_b = (np.asarray(batch.column(k)).astype(float) for k in (4, 5))
            j, behind = ss.estimate(_regs(batch.column(2)), _regs(batch.column(3)), n_a, n_b)
            ok = pa.array(_credible(j, behind, n_a, n_b))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j)], ["x", "y", "j"]).filter(ok)


def _credible(j: np.ndarray, behind: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    sizes = 100 * np.minimum(n_a, n_b) >= 75 * np.maximum(n_a, n_b)
    return sizes & ((j >= 0.75) | (behind <= SLACK))


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, of sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with 100 * intersection >= 75 * union of the full sets."""
    for batch in batches:
        ok = [_similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) for a, b in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(ok, pa.bool_()))


def _needed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set of each text that is of the class asked for."""
    for batch in batches:
        rows = [(c, s.tobytes()) for c, s in zip(batch.column(1).to_pylist(), _sets(batch.column(0))) if _class(s) == c]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["cls", "shingles"])


def _groups(batches: Iterator[pa.RecordBatch], rows: int = 4 * BLOCK) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by ``gid``, about ``rows`` rows at a time."""
    held: pa.Table | None = None
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            table = pa.Table.from_batches([batch.slice(a, rows)])
            held = table if held is None else pa.concat_tables([held, table])
            gid = np.asarray(held["gid"])
            cut = int(np.flatnonzero(gid != gid[-1])[-1]) + 1 if (gid != gid[-1]).any() else 0
            if cut >= rows // 2:
                yield held.slice(0, cut).combine_chunks()
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _likely_pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b) of one group and different components whose registers make a link credible.

    A pair that shares several bands is taken in the first of them only.
    """
    gid, comp, own = np.asarray(t["gid"]), np.asarray(t["comp"]), np.asarray(t["own"])
    one, n, band = np.asarray(t["one"]), np.asarray(t["n"]).astype(float), np.asarray(t["number"])
    regs = _regs(t["regs"])
    keys = ss.band_keys(regs)
    end = _group_ends(gid)
    todo = np.cumsum(end - np.arange(len(gid)) - 1)
    start = 0
    while start < len(gid):
        stop = max(start + 1, int(np.searchsorted(todo, (todo[start - 1] if start else 0) + 40_000, "right")))
        which, b = tb.expand(np.arange(start, stop) + 1, end[start:stop])
        a = which + start
        start = stop
        apart = (comp[a] != comp[b]) & (one[a] | (own[a] != own[b])) & (100 * np.minimum(n[a], n[b]) >= 75 * np.maximum(n[a], n[b]))
        a, b = a[apart], b[apart]
        near = (regs[a] == regs[b]).sum(1) >= FEWEST_EQUAL
        a, b = a[near], b[near]
        if len(a):
            first = (keys[a] == keys[b]).argmax(1) == band[a]
            a, b = a[first], b[first]
            j, behind = ss.estimate(regs[a], regs[b], n[a], n[b])
            good = _credible(j, behind, n[a], n[b])
            order = np.argsort(-j[good], kind="stable")
            yield a[good][order], b[good][order]


def _group_ends(gid: np.ndarray) -> np.ndarray:
    """End of the group of each row; rows of a group stand together."""
    last = np.flatnonzero(np.append(gid[1:] != gid[:-1], True)) + 1
    return np.repeat(last, np.diff(np.concatenate([[0], last])))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of buckets that have a credible partner in another component."""
    for t in _groups(batches):
        wanted = np.zeros(t.num_rows, bool)
        for a, b in _likely_pairs(t):
            wanted[a] = wanted[b] = True
        yield from t.filter(pa.array(wanted)).to_batches()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links across components; components that a link has joined are not compared again."""
    for t in _groups(batches):
        sets, cls, comp = t["shingles"], t["cls"].to_pylist(), np.asarray(t["comp"])
        made: dict[int, np.ndarray] = {}
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        def shingles(k: int) -> np.ndarray:
            if k not in made:
                made[k] = np.frombuffer(sets[k].as_py(), np.uint64)
            return made[k]

        x, y = [], []
        for a, b in _likely_pairs(t):
            for k, m in zip(a.tolist(), b.tolist()):
                p, q = root(int(comp[k])), root(int(comp[m]))
                if p != q and _similar(shingles(k), shingles(m)):
                    parent[max(p, q)] = min(p, q)
                    x.append(cls[k])
                    y.append(cls[m])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["x", "y"])


class _Finder:
    """The staged tables of one run."""

    def __init__(self, docs: DataFrame, key: str, text: str) -> None:
        self.texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
        self.rows = stage(self.texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketches, SKETCH))
        known = self.rows.where("cls is not null")
        self.classes = stage(known.groupBy("cls").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")))
        self.sets: DataFrame | None = None

    def bands(self, comps: DataFrame | None = None) -> DataFrame:
        """One row per class and band, with the component that the class has so far."""
        comp = F.col("rep") if comps is None else F.coalesce("component", "rep")
        placed = self.classes if comps is None else self.classes.join(comps, F.col("rep") == F.col("node"), "left")
        return placed.select("cls", "regs", comp.alias("comp")).mapInArrow(_bands, "band long, number int, cls binary, comp long")

    def credible(self, pairs: DataFrame) -> DataFrame:
        side = self.classes.select("cls", "n", "regs")
        x = side.select(F.col("cls").alias("x"), F.col("n").alias("n_x"), F.col("regs").alias("r_x"))
        y = side.select(F.col("cls").alias("y"), F.col("n").alias("n_y"), F.col("regs").alias("r_y"))
        joined = pairs.join(x, "x").join(y, "y").select("x", "y", "r_x", "r_y", "n_x", "n_y")
        return joined.mapInArrow(_estimates, "x binary, y binary, j double")

    def make_sets(self, need: DataFrame) -> DataFrame:
        """Staged full sets of the classes of ``need`` (one column cls), besides those made before."""
        if self.sets is not None:
            need = need.join(self.sets.select("cls"), "cls", "left_anti")
        ids = need.join(self.classes.select("cls", F.col("rep").alias("id")), "cls")
        made = self.texts.join(ids, "id").select("text", "cls").mapInArrow(_needed_sets, "cls binary, shingles binary")
        made = stage(made.groupBy("cls").agg(F.first("shingles").alias("shingles")))
        self.sets = made if self.sets is None else self.sets.union(made)
        return self.sets

    def check(self, pairs: DataFrame) -> DataFrame:
        """Links (x, y) among staged pairs, by full sets."""
        sets = self.make_sets(pairs.select(F.col("x").alias("cls")).union(pairs.select(F.col("y").alias("cls"))).distinct())
        x = sets.select(F.col("cls").alias("x"), F.col("shingles").alias("s_x"))
        y = sets.select(F.col("cls").alias("y"), F.col("shingles").alias("s_y"))
        joined = pairs.select("x", "y").join(x, "x").join(y, "y").select("x", "y", "s_x", "s_y")
        return joined.mapInArrow(_checked, "x binary, y binary")

    def as_ids(self, links: DataFrame) -> DataFrame:
        rep = self.classes.select("cls", "rep")
        a = rep.select(F.col("cls").alias("x"), F.col("rep").alias("a"))
        b = rep.select(F.col("cls").alias("y"), F.col("rep").alias("b"))
        return links.join(a, "x").join(b, "y").select("a", "b")

    def star_pairs(self) -> DataFrame:
        """Every member of a bucket with the bucket's smallest and largest class."""
        bands = self.bands().select("band", "cls")
        hubs = bands.groupBy("band").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi")
        pairs = bands.join(hubs, "band").select("cls", F.explode(F.array("lo", "hi")).alias("hub")).where("cls <> hub")
        return pairs.groupBy(F.col("cls").alias("x"), F.col("hub").alias("y")).agg(F.count("*").alias("_")).select("x", "y")

    def cross_links(self, comps: DataFrame) -> DataFrame:
        """Links across components among classes that share a bucket."""
        bands = self.bands(comps)
        open_ = bands.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
        members = bands.join(open_.select("band", "size"), "band").join(self.classes.select("cls", "n", "regs"), "cls")
        blocked = members.withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int"))
        blocked = blocked.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
        # Blocks i <= j of a bucket meet in one group: at most 2 * BLOCK classes or so.
        blocked = blocked.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        gid = F.xxhash64("band", F.least("own", "o"), F.greatest("own", "o"))
        dealt = blocked.select(gid.alias("gid"), "number", "cls", "comp", "n", "regs", "own", (F.col("own") == F.col("o")).alias("one"))
        schema = "gid long, number int, cls binary, comp long, n long, regs binary, own int, one boolean"
        found = stage(dealt.repartition("gid").sortWithinPartitions("gid").mapInArrow(_candidates, schema))
        sets = self.make_sets(found.select("cls").distinct())
        full = found.join(sets, "cls").repartition("gid").sortWithinPartitions("gid")
        return full.mapInArrow(_linked, "x binary, y binary")


def _lifted(links: DataFrame, comps: DataFrame) -> DataFrame:
    """The links between the components of their ends."""
    a = comps.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = comps.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    joined = links.join(a, "a", "left").join(b, "b", "left")
    return joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles, component_id and kept for every row, and ``text_hash``, xxhash64 of its text."""
    f = _Finder(docs, key, text)
    stars = stage(f.credible(f.star_pairs()))
    # Of the hubs that look sure the smallest, so that members of a group meet at one; else the likeliest.
    sure = F.col("j") >= SURE
    order = F.struct((~sure).alias("a"), F.when(sure, F.lit(0.0)).otherwise(-F.col("j")).alias("b"), F.col("y").alias("y"))
    best = stage(stars.groupBy("x").agg(F.min(order).alias("m")).select("x", F.col("m.y").alias("y")))
    links = stage(f.as_ids(f.check(best)))
    first = connected_components(links)
    cross = stage(f.cross_links(first))
    if not cross.isEmpty():
        more = stage(_lifted(f.as_ids(cross), first))
        second = connected_components(more).select(F.col("node").alias("component"), F.col("component").alias("smaller"))
        first = first.join(second, "component", "left").select("node", F.coalesce("smaller", "component").alias("component")).union(
            second.select(F.col("component").alias("node"), F.col("smaller").alias("component"))
        )
        unstage(more)
    comps = stage(first)
    for done in (stars, best, links, cross):
        unstage(done)
    classes = f.classes.join(comps, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("comp"))
    linked = f.rows.where("cls is not null").select("id", "n", "cls", "text_hash").join(classes, "cls").select("id", "n", "comp", "text_hash")
    alone = f.rows.where("cls is null").select("id", "n", F.col("id").alias("comp"), "text_hash")
    nameless = docs.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    nameless = nameless.mapInArrow(_sketches, SKETCH).select("id", "n", F.lit(None).cast("long").alias("comp"), "text_hash")
    found = linked.union(alone).union(nameless)
    return found.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"),
        F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept"), "text_hash",
    )


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one per component is left; of rows that agree in id and text one stays."""
    found = near_duplicates(docs, key=key, text=text).where(F.col(key).isNotNull())
    lost = stage(found.where(~F.col("kept")).select(F.col(key).alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    # The rows travel packed, so that working columns never meet the caller's.
    named = packed(docs).select(ROW, field(key).cast("long").alias("_id"), F.xxhash64(field(text)).alias("_hash"))
    left = named.join(lost, ["_id", "_hash"], "left_anti")
    again = found.where("kept").groupBy(key, "text_hash").count().where("count > 1")
    if not again.isEmpty():
        # Repeated rows: numbered within id and text, which only rows that agree in both share.
        number = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(1)))
        left = left.withColumn("_number", F.when(F.col("_id").isNull(), 1).otherwise(number)).where("_number = 1")
    return unpacked(left, docs.columns, {})
