"""Rounds of boosting as few, short jobs over cached blocks of arrays.

A round needs a dozen small results, one after the other; as DataFrame queries most
of its time is planning. Here the staged rows are cached once as numpy blocks, and
every step of a round is one job on them with nothing to plan:

* predictions, gradients, loss and the cells of the gradient threshold;
* the edges of the drawn rows among the row hashes near their expected place;
* one job a level while a node is large, whose histograms meet by (node, feature);
  when every open node has at most ``FINISHED`` rows, one more job deals the rows out
  by node and finishes all subtrees;
* sums per (leaf, fold) for the calibration.

Tasks exchange plain tuples, as classes travel by value and only with functions.
The driver sees tallies, one record per (node, feature), finished subtrees and
leaves x folds sums, never rows. The rules are those of ``sampling``, ``levels`` and
``leaf_calibration``, which remain for other samplers, losses and splitters.
"""

from __future__ import annotations

import hashlib
import math
import operator
import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from rareboost.functions.hashing import HASH_HEX_DIGITS, HASH_SPAN
from rareboost.functions.losses import log_loss_array, sigmoid_array
from rareboost.functions.selection import evenly
from rareboost.operators import leaf_calibration, levels
from rareboost.operators.binning import MAX_BINS, Binner
from rareboost.operators.histogram import GainSplitter
from rareboost.operators.sampling import MIN_PROBABILITY, Adaptive, Uniform
from rareboost.operators.trees import GrowthLimits, Node, Step, Tree, advanced, breadth_first, is_open, with_leaves

#: Rows that are worth a task of their own.
TASK_ROWS = 1 << 15
#: Rows of a chunk of the sample.
CHUNK = 1 << 16
#: Rows of a node up to which one task finishes its subtree.
FINISHED = 1 << 16
#: Distinct keys that a tally may return one by one, about.
READ = 1 << 16
#: Low bits of a gradient that the first tally of a large table leaves out.
COARSE = 44
#: Trees replayed on the cached blocks before these are advanced.
REPLAYED = 8


class Block(NamedTuple):
    """Rows of a training: keys as one text and their ends in it, labels, bins, predictions, and where calibration needs them folds."""

    keys: tuple[bytes, np.ndarray] | None
    y: np.ndarray
    codes: np.ndarray
    pred: np.ndarray
    oof: np.ndarray | None
    fold: np.ndarray | None


class Work(NamedTuple):
    """The rows of one round; ``loss`` is the sum of their losses before it."""

    y: np.ndarray
    codes: np.ndarray
    fold: np.ndarray | None
    g: np.ndarray
    h: np.ndarray
    hash: np.ndarray | None
    loss: float

    @property
    def pos(self) -> np.ndarray:
        return self.y > 0.5


class Tally(NamedTuple):
    """Distinct keys (or what their high bits are) in ascending order, with their rows and marked rows."""

    keys: np.ndarray
    rows: np.ndarray
    marked: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, rows: np.ndarray, marked: np.ndarray) -> "Tally":
        found, at = np.unique(keys, return_inverse=True)
        add = lambda weights: np.rint(np.bincount(at, weights, len(found))).astype(np.int64)
        return cls(found, add(rows), add(marked))

    @classmethod
    def merged(cls, parts: list[tuple]) -> "Tally":
        return cls.of(*(np.concatenate(column) for column in zip(*parts))) if parts else cls(*[np.empty(0, np.int64)] * 3)


class Edge(NamedTuple):
    """The wanted key, with the rows and marked rows beyond it and equal to it."""

    key: int
    beyond: int
    equal: int
    marked_beyond: int
    marked_equal: int


def fits(features: list[str], objective: object, sampler: object, splitter: object) -> bool:
    """Whether rounds of this kind can run on blocks."""
    drawn = type(sampler) is Uniform or type(sampler) is Adaptive and not sampler.quotas and not sampler.bonus
    return bool(features) and hasattr(objective, "arrays") and drawn and type(splitter) is GainSplitter


class Rounds:
    """The cached rows of one training and the steps of its rounds."""

    def __init__(self, staged: DataFrame, binner: Binner, config, rows: int, leaf_prior: float) -> None:
        self.binner, self.config, self.rows, self.leaf_prior = binner, config, rows, leaf_prior
        self.loaded: list[RDD] = []
        self.load(staged)

    def load(self, staged: DataFrame) -> None:
        """Cache the staged rows as blocks, in as many tasks as there are rows for."""
        self.close()
        named = self._tag() is not None
        # Only what there is: a column of missing values costs as much to pass on as any other.
        wanted = {"key": F.col("row_id").cast("string").cast("binary")} if named else {}
        wanted |= {c: F.col(c) if c == "codes" else F.col(c).cast("double") for c in ("y", "codes", "pred", "oof", "fold") if c in staged.columns}
        columns = staged.coalesce(max(1, -(-self.rows // TASK_ROWS))).select(*[c.alias(n) for n, c in wanted.items()])
        place = {n: i for i, n in enumerate(wanted)}

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    y, pred, oof, fold = (b.column(place[n]).to_numpy(zero_copy_only=False) if n in place else None for n in ("y", "pred", "oof", "fold"))
                    block = Block(
                        _texts(b.column(0)) if named else None, y, levels.bin_matrix(b.column(place["codes"])), pred,
                        None if oof is None or np.isnan(oof).all() else oof, None if fold is None or np.isnan(fold).any() else fold.astype(np.int32),
                    )
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tuple(block))], pa.binary())], names=["block"])

        self.base = self._keep(columns.mapInArrow(packed, "block binary").rdd.map(lambda r: pickle.loads(r[0])))
        # Trees that the cached blocks do not hold yet.
        self.steps: list[Step] = []

    def _keep(self, rdd: RDD) -> RDD:
        self.loaded.append(rdd.persist(StorageLevel.MEMORY_AND_DISK))
        return rdd

    def close(self) -> None:
        for rdd in self.loaded:
            rdd.unpersist()
        self.loaded = []

    def _tag(self) -> str | None:
        """Tag of the row hashes that the sampler draws by; None where it draws by none."""
        sampler = self.config.sampler
        if isinstance(sampler, Adaptive):
            return "adaptive"
        return "uniform" if sampler.rate < 1.0 else None

    def add(self, step: Step) -> None:
        self.steps.append(step)

    def work(self, round_: int) -> RDD:
        """Gradients, and the hashes to draw by, of every row; cached."""
        if len(self.steps) >= REPLAYED:
            steps, self.steps = self.steps, []
            self.base = self._keep(self.base.map(lambda b: tuple(_advanced(Block(*b), steps))))
        steps, objective, tag, seed = self.steps, self.config.objective, self._tag(), self.config.sampler.seed

        def run(block: tuple) -> tuple:
            block = _advanced(Block(*block), steps)
            g, h = objective.arrays(block.y, block.pred)
            hashes = None if tag is None else _hashes(block.keys, tag, seed, round_)
            return (block.y, block.codes, block.fold, g, h, hashes, float(log_loss_array(block.y, sigmoid_array(block.pred)).sum()))

        return self.base.map(run).persist(StorageLevel.MEMORY_AND_DISK)

    def overview(self, work: RDD) -> tuple[float, Tally, int]:
        """Mean loss; the gradients' sizes by label, as far as a first pass tells them, and the bits that it left out."""
        shift = 0 if self.rows <= READ else COARSE
        wanted = isinstance(self.config.sampler, Adaptive)

        def run(blocks: Iterator[tuple]) -> Iterator[tuple[float, tuple]]:
            loss, tallies = 0.0, []
            for w in map(Work._make, blocks):
                loss += w.loss
                if wanted:
                    tallies.append(_tally(*_sizes(w), shift))
            yield loss, tuple(Tally.merged(tallies))

        losses, tallies = zip(*work.mapPartitions(run).collect())
        return math.fsum(losses) / self.rows, Tally.merged(list(tallies)), shift

    def sample(self, work: RDD, tally: Tally | None, shift: int, positives: int) -> tuple[RDD, int]:
        """Chunks ``(codes, weighted g, weighted h, positive)`` of the drawn rows, cached, and how many rows these are at most, about."""
        sampler = self.config.sampler
        if isinstance(sampler, Adaptive):
            drawn, rows = self._adaptive(work, tally, shift, positives)
        else:
            rate = sampler.rate
            drawn = (lambda w: np.ones(len(w.y))) if rate >= 1.0 else (lambda w: np.where(w.hash / float(HASH_SPAN) < rate, 1.0 / rate, 0.0))
            rows = self.rows

        def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
            held, size = [], 0
            for w in map(Work._make, blocks):
                weight = drawn(w)
                at = np.flatnonzero(weight)
                held.append((w.codes[at], w.g[at] * weight[at], w.h[at] * weight[at], w.pos[at]))
                size += len(at)
                if size >= CHUNK:
                    yield _joined(held)
                    held, size = [], 0
            if size:
                yield _joined(held)

        return work.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK), rows

    def _adaptive(self, work: RDD, tally: Tally, shift: int, positives: int) -> tuple[Callable[[Work], np.ndarray], int]:
        """Weight of every row, 0 if it is not drawn, and the number of drawn rows: large gradients, and of both labels' rest those of least hash."""
        sampler, ranked = self.config.sampler, int(tally.rows.sum())
        k = min(math.ceil(ranked * sampler.keep), ranked)
        pool, threshold, top = {2: positives, 3: self.rows - positives}, math.inf, (0, 0)
        if k >= 1:
            edge = _largest(tally, shift, k, lambda *cell: _tally_of(work, _sizes, *cell))
            threshold = float(np.uint64(edge.key).view(np.float64))
            marked = edge.marked_beyond + edge.marked_equal
            top = (marked, edge.beyond + edge.equal - marked)
            pool = {2: positives - top[0], 3: self.rows - positives - top[1]}
        target = sampler.target if sampler.target is not None else (top[0] + pool[2]) / max(self.rows, 1)
        budget = math.ceil((pool[2] + pool[3]) * sampler.rest)
        take_pos = math.floor(budget * target + 0.5)
        take = {2: take_pos, 3: max(budget - take_pos, 0)}
        weights = np.ones(4)
        for s in (2, 3):
            weights[s] = 1.0 / max(min(1.0, take[s] / pool[s]), MIN_PROBABILITY) if pool[s] else 1.0
        wanted = {s: min(take[s], pool[s]) for s in (2, 3)}
        strata = lambda w: _strata(w, threshold)
        edges = _least_hashes(work, strata, wanted, pool)

        def drawn(w: Work) -> np.ndarray:
            s = strata(w)
            return np.where((s < 2) | (w.hash <= edges[s]), weights[s], 0.0)

        return drawn, sum(top) + sum(wanted.values())

    def grow(self, sample: RDD, rows: int, only: list[int] | None) -> Tree:
        """The tree of ``trees.grow`` on the chunks of a sample."""
        limits, splitter = self.config.limits, self.config.splitter
        features = list(range(len(self.binner.features))) if only is None else only
        choose = splitter.cutter(limits.lam, limits.min_child_weight)
        nodes, stats = [Node()], {0: (0.0, 0.0, rows)}
        open_, depth = [0], 0
        while open_:
            routing = levels.Routing.of(nodes, depth)
            if max(stats[i][2] for i in open_) <= FINISHED:
                for at, (more, found) in _finished(sample, routing, open_, features, choose, limits, depth):
                    _graft(nodes, stats, at, more, found)
                break
            found = _level(sample, routing, open_, features, choose)
            if depth == 0:
                stats[0] = next((r[1:4] for r in found), (0.0, 0.0, 0))
            open_ = _split(nodes, stats, found, limits, depth)
            depth += 1
        nodes, stats = breadth_first(nodes, stats)
        for n in nodes:
            if n.feature >= 0:
                n.threshold = self.binner.uppers[n.feature][n.split_bin]
        return with_leaves(nodes, stats, limits.lam)

    def calibrate(self, work: RDD, tree: Tree) -> list[list[float]] | None:
        """``boosting._calibrate`` on blocks."""
        routing, leaf = levels.Routing.of(tree.nodes, tree.depth), np.array([max(n.leaf, 0) for n in tree.nodes])
        shape = (tree.n_leaves, self.config.k_folds)

        def run(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
            sums = np.zeros((4, shape[0] * shape[1]))
            for w in map(Work._make, blocks):
                at = leaf[routing.position(w.codes)] * shape[1] + w.fold
                for i, weight in enumerate((w.g, w.h, None, w.pos)):
                    sums[i] += np.bincount(at, weight, sums.shape[1])
            yield sums

        sums = sum(work.mapPartitions(run).collect()).reshape(4, *shape)
        by_fold = leaf_calibration.calibrate_arrays(tree, sums, self.config.lam, self.leaf_prior)
        if self.config.null_leaf == "prior":
            tree.leaf_probs = [p if p > 0.0 else self.leaf_prior for p in tree.leaf_probs]
        return by_fold if self.config.calibration == "platt" else None


# --- draws ----------------------------------------------------------------------------


def _advanced(block: Block, steps: list[Step]) -> Block:
    if not steps:
        return block
    pred, oof = advanced(block.codes, block.pred, block.oof, block.fold, steps)
    return block._replace(pred=pred, oof=oof)


def _texts(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all keys, and the places where they begin and end; an object each would cost more than its hash."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    text = b"" if data is None else data.slice(ends[0], ends[-1] - ends[0]).to_pybytes()
    return text, ends - ends[0]


def _hashes(keys: tuple[bytes, np.ndarray], tag: str, seed: int, round_: int) -> np.ndarray:
    """``hashing.row_hash`` of every key."""
    suffix, md5, text, ends = f"|{seed}|{round_}|{tag}".encode(), hashlib.md5, keys[0], keys[1].tolist()
    digests = b"".join([md5(text[a:b] + suffix).digest() for a, b in zip(ends, ends[1:])])
    return (np.frombuffer(digests, ">u8")[::2] >> np.uint64(64 - 4 * HASH_HEX_DIGITS)).astype(np.int64)


def _sizes(w: Work) -> tuple[np.ndarray, np.ndarray]:
    """Absolute gradients as whole numbers of the same order, without missing ones; and whether their rows are positive."""
    there = ~np.isnan(w.g)
    return np.abs(w.g[there]).view(np.int64), w.pos[there]


def _tally(keys: np.ndarray, marked: np.ndarray, shift: int) -> Tally:
    return Tally.of(keys >> shift, np.ones(len(keys)), marked.astype(float))


def _tally_of(work: RDD, keys_of: Callable[[Work], tuple[np.ndarray, np.ndarray]], cell: int, shift: int, finer: int) -> Tally:
    """The keys of one cell of a tally, at finer bits."""

    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        parts = []
        for w in map(Work._make, blocks):
            keys, marked = keys_of(w)
            inside = keys >> shift == cell
            parts.append(_tally(keys[inside], marked[inside], finer))
        yield tuple(Tally.merged(parts))

    return Tally.merged(work.mapPartitions(run).collect())


def _largest(tally: Tally, shift: int, k: int, again: Callable[[int, int, int], Tally]) -> Edge:
    """The k-th largest key: the cell that holds it is read again, at finer bits, until it is one key."""
    beyond = marked = 0
    while True:
        upto = tally.rows[::-1].cumsum()
        i = int(np.searchsorted(upto, k - beyond))
        at = len(tally.keys) - 1 - i
        cell, equal, marked_equal = (int(column[at]) for column in tally)
        beyond, marked = beyond + int(upto[i]) - equal, marked + int(tally.marked[at + 1 :].sum())
        if shift == 0:
            return Edge(cell, beyond, equal, marked, marked_equal)
        finer = 0 if equal <= READ else max(shift - 16, 0)
        tally, shift = again(cell, shift, finer), finer


def _strata(w: Work, threshold: float) -> np.ndarray:
    """Large gradients of positive and other rows, then the rest of both."""
    with np.errstate(invalid="ignore"):
        high = np.abs(w.g) >= threshold
    return np.where(high, 0, 2) + ~w.pos


def _least_hashes(work: RDD, strata: Callable[[Work], np.ndarray], wanted: dict[int, int], pool: dict[int, int]) -> np.ndarray:
    """Per stratum the hash up to which its wanted rows lie (-1: none); rows that share it are drawn together.

    Hashes are evenly spread, so one pass that reads those near the expected place
    nearly always holds the edge; if not, the hashes are tallied from their high bits on.
    """
    edges = np.full(4, -1, np.int64)
    near = {s: evenly(n, pool[s], HASH_SPAN) for s, n in wanted.items() if 0 < n < pool[s]}
    for s, n in wanted.items():
        if n and n == pool[s]:
            edges[s] = HASH_SPAN
    if not near:
        return edges

    def run(blocks: Iterator[tuple]) -> Iterator[dict]:
        below, inside = dict.fromkeys(near, 0), {s: [] for s in near}
        for w in map(Work._make, blocks):
            stratum = strata(w)
            for s, (lo, hi) in near.items():
                hashes = w.hash[stratum == s]
                below[s] += int((hashes < lo).sum())
                inside[s].append(hashes[(hashes >= lo) & (hashes <= hi)])
        yield {s: (below[s], np.concatenate(inside[s]) if inside[s] else np.empty(0, np.int64)) for s in near}

    seen = work.mapPartitions(run).collect()
    for s in near:
        rank = wanted[s] - sum(part[s][0] for part in seen)
        hashes = np.sort(np.concatenate([part[s][1] for part in seen]))
        if 1 <= rank <= len(hashes):
            edges[s] = hashes[rank - 1]
            continue

        def turned(w: Work, s: int = s) -> tuple[np.ndarray, np.ndarray]:
            keys = HASH_SPAN - w.hash[strata(w) == s]
            return keys, np.zeros(len(keys))

        top = 4 * HASH_HEX_DIGITS + 1
        edge = _largest(_tally_of(work, turned, 0, top, COARSE), COARSE, wanted[s], lambda *cell, turned=turned: _tally_of(work, turned, *cell))
        edges[s] = HASH_SPAN - edge.key
    return edges


# --- growth ---------------------------------------------------------------------------


def _joined(parts: list[tuple]) -> tuple:
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(column) for column in zip(*parts))


def _sums(codes: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, pos: np.ndarray, slots: int, features: list[int]) -> np.ndarray:
    """Histograms ``(slot, feature, bin, measure)``: weighted gradient and hessian, rows, positive rows."""
    size = slots * MAX_BINS
    out = np.empty((len(features), 4, size))
    base, rare = slot * MAX_BINS, np.flatnonzero(pos)
    for k, f in enumerate(features):
        at = base + codes[:, f]
        for m, (where, weight) in enumerate(((at, g), (at, h), (at, None), (at[rare], None))):
            out[k, m] = np.bincount(where, weight, size)
    return out.reshape(len(features), 4, slots, MAX_BINS).transpose(2, 0, 3, 1)


def _records(cells: np.ndarray, choose: Callable) -> list[tuple]:
    """``(g, h, n, bin, score, gl, hl, nl, gr, hr, nr)`` of every histogram; bin -1 where there is no cut."""
    total = cells.sum(axis=1)
    bin_, score, sides = choose(cells)
    return list(zip(total[:, 0].tolist(), total[:, 1].tolist(), total[:, 2].astype(int).tolist(), bin_.tolist(), score.tolist(), *(s.tolist() for s in sides)))


def _best(found: list[tuple]) -> list[tuple]:
    """Of records ``(node, feature, ...)`` in this order the best of every node, the lowest feature of equal ones; cut off at the record's feature."""
    best: dict[int, tuple] = {}
    for node, feature, *r in sorted(found, key=lambda r: r[:2]):
        if node not in best or r[4] > best[node][5]:
            best[node] = (node, *r[:3], feature if r[3] >= 0 else -1, r[4], r[3], *r[5:])
    return list(best.values())


def _split(nodes: list[Node], stats: dict[int, tuple], found: list[tuple], limits: GrowthLimits, depth: int) -> list[int]:
    """Split the nodes that may be split, as ``trees.grow`` does; the children that are open."""
    opened = []
    for node, _, _, _, feature, _, bin_, gl, hl, nl, gr, hr, nr in found:
        if feature < 0 or not is_open(stats[node], limits) or depth >= limits.max_depth or min(nl, nr) < limits.min_samples_leaf:
            continue
        left = len(nodes)
        nodes[node] = Node(feature, bin_, left=left)
        nodes += [Node(), Node()]
        stats[left], stats[left + 1] = (gl, hl, int(nl)), (gr, hr, int(nr))
        opened += [c for c in (left, left + 1) if depth + 1 < limits.max_depth and is_open(stats[c], limits)]
    return opened


def _level(sample: RDD, routing: levels.Routing, open_: list[int], features: list[int], choose: Callable) -> list[tuple]:
    """The best record of every open node: histograms are summed in tasks and meet by (node, feature)."""
    slot_of = np.full(len(routing.cut), -1, np.int64)
    slot_of[open_] = np.arange(len(open_))

    def parts(chunks: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        sums = np.zeros((len(open_), len(features), MAX_BINS, 4))
        for codes, g, h, pos in chunks:
            slot = slot_of[routing.position(codes)]
            at = np.flatnonzero(slot >= 0)
            sums += _sums(codes[at], slot[at], g[at], h[at], pos[at], len(open_), features)
        for i, cells in enumerate(sums.reshape(-1, MAX_BINS, 4)):
            if cells[:, 2].any():
                yield i, cells

    def chosen(merged: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple]:
        places, cells = [], []
        for place, part in merged:
            places.append(place)
            cells.append(part)
        if cells:
            for place, record in zip(places, _records(np.stack(cells), choose)):
                yield open_[place // len(features)], features[place % len(features)], *record

    groups = len(open_) * len(features)
    n = min(groups, -(-groups * sample.getNumPartitions() // levels.PARTS_A_TASK))
    return _best(sample.mapPartitions(parts).reduceByKey(operator.add, n).mapPartitions(chosen).collect())


def _finished(
    sample: RDD, routing: levels.Routing, open_: list[int], features: list[int], choose: Callable, limits: GrowthLimits, depth: int
) -> list[tuple[int, tuple[list[Node], dict]]]:
    """Subtrees of open nodes of few rows: the rows meet by node, and one task finishes each."""
    is_wanted = np.zeros(len(routing.cut), bool)
    is_wanted[open_] = True

    def dealt(task: int, chunks: Iterator[tuple]) -> Iterator[tuple]:
        for i, (codes, g, h, pos) in enumerate(chunks):
            node = routing.position(codes)
            for at in np.unique(node[is_wanted[node]]).tolist():
                rows = np.flatnonzero(node == at)
                yield at, (task, i, codes[rows], g[rows], h[rows], pos[rows])

    def finish(parts: Iterator[tuple]) -> tuple[list[tuple], dict]:
        # In one order, whichever way the shuffle brought them.
        nodes, stats = _subtree(*_joined([p[2:] for p in sorted(parts, key=lambda p: p[:2])]), features, choose, limits, depth)
        return [(n.feature, n.split_bin, n.left) for n in nodes], stats

    tasks = min(len(open_), sample.getNumPartitions())
    trees = sorted(sample.mapPartitionsWithIndex(dealt).groupByKey(tasks).mapValues(finish).collect(), key=lambda r: r[0])
    return [(at, ([Node(f, b, left=left) for f, b, left in nodes], stats)) for at, (nodes, stats) in trees]


def _subtree(
    codes: np.ndarray, g: np.ndarray, h: np.ndarray, pos: np.ndarray, features: list[int], choose: Callable, limits: GrowthLimits, depth: int
) -> tuple[list[Node], dict]:
    """Nodes below and with one node, from its rows."""
    nodes, stats, open_, start = [Node()], {}, [0], depth
    at = np.zeros(len(g), np.int64)
    while open_:
        slot_of = np.full(len(nodes), -1, np.int64)
        slot_of[open_] = np.arange(len(open_))
        slot = slot_of[at]
        rows = np.flatnonzero(slot >= 0)
        cells = _sums(codes[rows], slot[rows], g[rows], h[rows], pos[rows], len(open_), features)
        records = _records(cells.reshape(-1, MAX_BINS, 4), choose)
        found = _best([(open_[i // len(features)], features[i % len(features)], *r) for i, r in enumerate(records)])
        if depth == start:
            stats[0] = found[0][1:4]
        open_ = _split(nodes, stats, found, limits, depth)
        cut = np.array([n.feature * MAX_BINS + n.split_bin if n.feature >= 0 and n.left >= len(slot_of) else -1 for n in nodes])[at]
        moved = np.flatnonzero(cut >= 0)
        beyond = codes[moved, cut[moved] // MAX_BINS] > cut[moved] % MAX_BINS
        at[moved] = np.array([n.left for n in nodes])[at[moved]] + beyond
        depth += 1
    return nodes, stats


def _graft(nodes: list[Node], stats: dict[int, tuple], at: int, more: list[Node], found: dict[int, tuple]) -> None:
    """Put a finished subtree in the place of a node; the node keeps the sums that its parent's split gave it."""
    base = len(nodes) - 1
    for i, n in enumerate(more):
        n.left = n.left + base if n.feature >= 0 else -1
        if i:
            nodes.append(n)
            stats[base + i] = found[i]
    nodes[at] = more[0]
    if at == 0:
        stats[0] = found[0]
