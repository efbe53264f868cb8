"""Exact order statistics between sketched bounds, without a global sort.

A mergeable quantile sketch guesses two bounds around every wanted rank. The next
pass counts the rows at and between all bounds exactly, so a wrong guess costs a
pass and never a wrong value; where the rows between two bounds are few, the same
pass also returns their keys. Rows at a bound are counted apart from those between,
so a crowd of equal keys leaves at once. Every pass is one scan with map-side
combining that keeps about one row in 200 of a gap, whatever the distribution; the
driver sees at most about ``READ`` counters and ``SALTS`` short grids per gap.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rareboost.session import Scratch

#: Most keys that a pass returns to the driver, about.
READ = 1 << 14
#: Quantiles read from a sketch, and one over the sketch's relative rank error.
GRID = 1000
ACCURACY = 4000
#: Sketches of a gap that are merged apart, so that no single task merges those of all others.
SALTS = 32
# One text instead of a literal per quantile, which would take longer to build than to compute.
_SKETCH = f"percentile_approx(_near, array({', '.join(f'{i / GRID}D' for i in range(GRID + 1))}), {ACCURACY})"
#: Share of a gap's rows between a wanted rank and its guessed bounds.
SLACK = 2 / GRID + 2 / ACCURACY
#: Gaps that share a pass.
GAPS = 128
#: More rows of one 56-bit hash than this are no accident.
COLLISIONS = 1000


@dataclass(frozen=True)
class Cut:
    """Key value at a rank, with the rows strictly below it and equal to it, and the marked rows up to and with it."""

    value: Any
    below: int
    equal: int
    marked: int = 0


@dataclass
class _Gap:
    """Rows of a group strictly between ``lo`` and ``hi`` (None: no bound), and the bounds that cut them next.

    ``close`` numbers the parts between bounds in which the ranks are expected;
    ``expected`` is how many rows these have together.
    """

    group: Any
    ranks: list[int]
    lo: Any = None
    hi: Any = None
    below: int = 0
    marked: int = 0
    bounds: list = field(default_factory=list)
    close: list[int] = field(default_factory=lambda: [0])
    expected: float = math.inf

    def cut_around(self, pairs: list[tuple[Any, Any]], expected: float) -> "_Gap":
        self.bounds = sorted({v for pair in pairs for v in pair})
        inside = [any(a <= x and y <= b for a, b in pairs) for x, y in zip(self.bounds, self.bounds[1:])]
        self.close = [2 * i + 2 for i, here in enumerate(inside) if here]
        self.expected = expected
        return self

    def slot(self, first: int) -> Column:
        """Even: between bounds; odd: at a bound; NULL outside the gap."""
        key = F.col("_key")
        out = F
        for i, b in enumerate(self.bounds):
            out = out.when(key < F.lit(b), first + 2 * i).when(key <= F.lit(b), first + 2 * i + 1)
        last = F.lit(first + 2 * len(self.bounds))
        inside = out.otherwise(last) if self.bounds else last
        limits = [key > F.lit(self.lo)] * (self.lo is not None) + [key < F.lit(self.hi)] * (self.hi is not None)
        return F.when(reduce(lambda x, y: x & y, limits), inside) if limits else inside


def _in_group(group: Column | None, value: Any) -> Column:
    return F.lit(True) if group is None else group.eqNullSafe(F.lit(value))


def _any_group(group: Column, values: list) -> Column:
    present = [v for v in values if v is not None]
    here = group.isin(present) if present else F.lit(False)
    return here | group.isNull() if None in values else F.coalesce(here, F.lit(False))


def _per_group(group: Column | None, values: dict[Any, Any]) -> Column:
    """The value of a row's group; NULL for a group that is not listed."""
    if group is None:
        return F.lit(values[None])
    return F.coalesce(*[F.when(_in_group(group, g), F.lit(v)) for g, v in values.items()])


def order_cuts(
    df: DataFrame,
    key: Column,
    ranks: dict[Any, Callable[[int], list[int]]] | Callable[[int], list[int]],
    group: Column | None = None,
    sizes: dict[Any, int] | None = None,
    span: int | None = None,
) -> dict[Any, dict[int, Cut]]:
    """Exact ``Cut`` at the wanted 1-based ascending ranks, per group.

    ``ranks`` maps a group value to a function of the group's row count that
    returns the wanted ranks; without ``group`` pass the function itself and read
    the result under ``None``. Rows with a NULL or NaN key have no rank. Where a
    group's row count is known and its keys are evenly spread over 0 to ``span``, as
    hashes are, ``sizes`` and ``span`` spare the sketch.
    """
    wanted = ranks if isinstance(ranks, dict) else {None: ranks}
    known = {} if sizes is None or span is None else {g: sizes[g] for g in wanted}
    grp = None if group is None else F.col("_grp")
    groups = list(wanted)
    found: dict[Any, dict[int, Cut]] = {}
    with Scratch() as scratch:
        rows = _keyed(df, key, group, None)
        # Cached before any filter, so that the key is computed once and not once per condition. A key that
        # is read in one pass is not cached; that pass has no filter on it, for the same reason.
        ranked = rows if known else scratch.keep(rows).where("_key is not null")
        for start in range(0, len(groups), GAPS):
            some = {g: wanted[g] for g in groups[start : start + GAPS]}
            found |= _locate(ranked if group is None else ranked.where(_any_group(grp, list(some))), some, grp, known, span)
    return found


def marked_cuts(df: DataFrame, key: Column, mark: Column, ranks: Callable[[int], list[int]]) -> tuple[dict[int, Cut], int, int]:
    """Cuts of the whole table that also count marked rows; the marked and the unmarked rows, ranked or not."""
    with Scratch() as scratch:
        rows = scratch.keep(_keyed(df, key, None, mark))
        totals: dict[bool, int] = {}
        found = _locate(rows, {None: ranks}, None, {}, None, totals)
        return found[None], totals.get(True, 0), totals.get(False, 0)


def _keyed(df: DataFrame, key: Column, group: Column | None, mark: Column | None) -> DataFrame:
    named = df.select(
        key.alias("_key"),
        (F.lit(None).cast("string") if group is None else group).alias("_grp"),
        (F.lit(False) if mark is None else F.coalesce(mark, F.lit(False))).alias("_mark"),
    )
    if named.schema["_key"].dataType.typeName() in ("double", "float"):
        named = named.withColumn("_key", F.when(~F.isnan("_key"), F.col("_key")))
    return named


def _locate(
    rows: DataFrame, wanted: dict, grp: Column | None, known: dict[Any, int], span: int | None, totals: dict[bool, int] | None = None
) -> dict[Any, dict[int, Cut]]:
    found: dict[Any, dict[int, Cut]] = {g: {} for g in wanted}
    open_ = [_Gap(g, []) for g in wanted]
    for gap in open_ if known else []:
        gap.ranks = _valid(wanted[gap.group], known[gap.group])
        spread = {r: evenly(r, known[gap.group], span) for r in gap.ranks}
        gap.cut_around(list(spread.values()), sum((b - a) / span * known[gap.group] + 1 for a, b in spread.values()))
    open_ = [g for g in open_ if g.ranks] if known else open_
    sized = bool(known)
    while open_:
        batch, open_ = open_[:GAPS], open_[GAPS:]
        parts = _pass(rows, batch, grp, totals, not known)
        for gap, slots in zip(batch, parts):
            if not sized:
                gap.ranks = _valid(wanted[gap.group], slots[0].count)
            open_ += _settle(gap, slots, found[gap.group])
        sized = True
    return found


def _valid(ranks: Callable[[int], list[int]], n: int) -> list[int]:
    return sorted({r for r in ranks(n) if 1 <= r <= n})


def evenly(rank: int, n: int, span: int) -> tuple[int, int]:
    """Six standard deviations around the value expected at a rank of ``n`` evenly spread keys."""
    at = rank / n
    away = 6 * math.sqrt(at * (1 - at) / n) + 6 / n
    return max(int((at - away) * span), 0), min(int((at + away) * span), span)


@dataclass
class _Slot:
    """What a pass saw of the rows of one slot: counts, and either single keys or grids of a sketch."""

    count: int = 0
    marked: int = 0
    keys: list[tuple[Any, int, int]] = field(default_factory=list)
    grids: list[tuple[int, list]] = field(default_factory=list)
    least: Any = None
    most: Any = None

    def add(self, r: Any) -> None:
        self.count += r["n"]
        self.marked += r["m"]
        if r["_read"] is not None:
            self.keys.append((r["_read"], r["n"], r["m"]))
        if r["grid"] is not None:
            self.grids.append((r["n"], r["grid"]))
            self.least = r["lo"] if self.least is None else min(self.least, r["lo"])
            self.most = r["hi"] if self.most is None else max(self.most, r["hi"])


def _pass(rows: DataFrame, gaps: list[_Gap], grp: Column | None, totals: dict[bool, int] | None, filtered: bool) -> list[list[_Slot]]:
    """Count all slots of the gaps; close parts are read key by key if they are few rows, else sketched.

    Unless ``filtered``, rows without a key or a slot are counted too, and passed by here.
    """
    firsts = np.cumsum([0] + [2 * len(g.bounds) + 1 for g in gaps]).tolist()
    few = sum(g.expected for g in gaps) <= READ
    close = [first + c for g, first in zip(gaps, firsts) for c in g.close]
    slot = F.coalesce(*[F.when(_in_group(grp, g.group), g.slot(first)) for g, first in zip(gaps, firsts)])
    if not filtered:
        slot = F.when(F.col("_key").isNotNull(), slot)
    elif totals == {}:
        slot = F.when(F.col("_key").isNotNull(), slot).otherwise(-1)
    elif totals:
        rows = rows.where("_key is not null")
    is_close = F.col("_slot").isin(close)
    near = F.when(is_close, F.col("_key"))
    read, salt = (near, F.lit(0)) if few else (F.lit(None).cast("int"), F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    grid = F.lit(None) if few else F.expr(_SKETCH)
    lowest, highest = (F.lit(None), F.lit(None)) if few else (F.min("_near"), F.max("_near"))
    slotted = rows.withColumn("_slot", slot)
    counted = (
        (slotted.where("_slot is not null") if filtered else slotted)
        .select("_slot", read.alias("_read"), salt.alias("_salt"), near.alias("_near"), "_mark")
        .groupBy("_slot", "_read", "_salt")
        .agg(F.count("*").alias("n"), F.count_if("_mark").alias("m"), lowest.alias("lo"), highest.alias("hi"), grid.alias("grid"))
        .collect()
    )
    slots = [_Slot() for _ in range(firsts[-1] + 1)]
    for r in counted:
        if r["_slot"] is not None:
            slots[r["_slot"]].add(r)
    if totals is not None and not totals:
        totals[True] = sum(r["m"] for r in counted)
        totals[False] = sum(r["n"] for r in counted) - totals[True]
    return [slots[first:end] for first, end in zip(firsts, firsts[1:])]


def _settle(gap: _Gap, slots: list[_Slot], found: dict[int, Cut]) -> list[_Gap]:
    """Note the cuts that a pass has found; the gaps in which ranks are still open."""
    out = []
    below, marked = gap.below, gap.marked
    for i, slot in enumerate(slots):
        inside = [r for r in gap.ranks if below < r <= below + slot.count]
        if inside and i % 2:
            found.update({r: Cut(gap.bounds[i // 2], below, slot.count, marked + slot.marked) for r in inside})
        elif inside and slot.keys:
            _pick(slot, inside, below, marked, found)
        elif inside and slot.grids and slot.least == slot.most:
            found.update({r: Cut(slot.least, below, slot.count, marked + slot.marked) for r in inside})
        elif inside:
            lo = gap.bounds[i // 2 - 1] if i else gap.lo
            hi = gap.bounds[i // 2] if i // 2 < len(gap.bounds) else gap.hi
            part = _Gap(gap.group, inside, lo, hi, below, marked)
            out.append(_guess(part, slot) if slot.grids else part)
        below, marked = below + slot.count, marked + slot.marked
    return out


def _pick(slot: _Slot, ranks: list[int], below: int, marked: int, found: dict[int, Cut]) -> None:
    todo = list(ranks)
    for key, n, m in sorted(slot.keys):
        while todo and todo[0] <= below + n:
            found[todo.pop(0)] = Cut(key, below, n, marked + m)
        below, marked = below + n, marked + m


def _guess(gap: _Gap, slot: _Slot) -> _Gap:
    """Bounds around the ranks of a gap from the grids of its sketches."""
    values = np.array([v for _, grid in slot.grids for v in grid])
    weights = np.repeat([n / (GRID + 1) for n, _ in slot.grids], [len(grid) for _, grid in slot.grids])
    order = np.argsort(values, kind="stable")
    values, upto = values[order].tolist(), np.cumsum(weights[order])

    def near(share: float) -> Any:
        if not 0 < share < 1:
            return slot.least if share <= 0 else slot.most
        at = min(int(np.searchsorted(upto, share * upto[-1])), len(values) - 1)
        # A sketch works in doubles; what rounding brings outside is no bound.
        return min(max(values[at], slot.least), slot.most)

    shares = [(r - gap.below - 0.5) / slot.count for r in gap.ranks]
    pairs = [(near(s - SLACK), near(s + SLACK)) for s in shares]
    return gap.cut_around(pairs, len(pairs) * (2 * SLACK * slot.count + 2))


def head_filter(
    df: DataFrame,
    keys: list[Column],
    counts: dict[Any, Callable[[int], int]] | Callable[[int], int],
    group: Column | None = None,
    tie: str = "row_id",
    sizes: dict[Any, int] | None = None,
    span: int | None = None,
) -> Column:
    """Predicate that keeps exactly the first ``counts(n)`` rows in the order of ``keys``.

    Ties on every key are broken by the ``tie`` column; make the last key a row
    hash so that such ties are hash collisions and never a crowd. The rows are
    never sorted or moved: the answer is a comparison against exact thresholds.
    ``sizes`` and ``span`` describe the first key as for ``order_cuts``.
    """
    wanted = counts if isinstance(counts, dict) else {None: counts}
    if not wanted:
        return F.lit(False)
    if not keys:
        return _first_names(df, wanted, group, tie)
    ranks = {g: (lambda n, f=f: [min(max(f(n), 0), n)]) for g, f in wanted.items()}
    found = order_cuts(df, keys[0], ranks if group is not None else ranks[None], group, sizes, span)
    cuts = {g: next(iter(c.items())) for g, c in found.items() if c}
    # Groups whose cut falls inside a crowd of equal keys go on with the next key, together.
    crowded = {g: (cut.value, rank - cut.below) for g, (rank, cut) in cuts.items() if rank - cut.below < cut.equal}
    if not cuts:
        return F.lit(False)
    # One comparison against the row's own threshold; later keys are read for ties only.
    edge = _per_group(group, {g: cut.value for g, (_, cut) in cuts.items()})
    if not crowded:
        return F.coalesce(keys[0] <= edge, F.lit(False))
    crowd = _per_group(group, {g: v for g, (v, _) in crowded.items()})
    quotas = {g: (lambda n, k=k: k) for g, (_, k) in crowded.items()}
    inner = head_filter(df.where(keys[0] == crowd), keys[1:], quotas, group, tie)
    settled = F.lit(False) if group is None else ~_any_group(group, list(crowded))
    return F.coalesce((keys[0] < edge) | ((keys[0] == edge) & (settled | inner)), F.lit(False))


def _first_names(df: DataFrame, wanted: dict, group: Column | None, tie: str) -> Column:
    """Rows equal on every key, hash included: a handful of hash collisions at most.

    A larger crowd, or a cut between rows of one name, means that names are NULL
    or repeat; no predicate can tell such rows apart.
    """
    parts = []
    for g, count in wanted.items():
        rows = df.where(_in_group(group, g))
        n = rows.count()
        take = count(n)
        if n > COLLISIONS:
            raise ValueError(f"{n} rows agree in {tie} or have none; row keys must be unique")
        names = [r[0] for r in rows.select(tie).orderBy(tie).collect()]
        if 0 < take < n and names[take - 1] == names[take] or None in names[:take]:
            raise ValueError(f"{tie} repeats or is NULL; row keys must be unique")
        names = names[:take]
        parts.append(_in_group(group, g) & F.col(tie).isin(names))
    return reduce(lambda a, b: a | b, parts)


def boundaries_filter(
    df: DataFrame,
    keys: list[Column],
    ranks: dict[Any, Callable[[int], list[int]]] | Callable[[int], list[int]],
    group: Column | None = None,
    tie: str = "row_id",
) -> dict[Any, list[Column]]:
    """Per group, one ``head_filter`` predicate for every wanted rank, from shared passes."""
    return {g: [test(keys[0]) for test in tests] for g, tests in boundary_tests(df, keys, ranks, group, tie).items()}


def boundary_tests(
    df: DataFrame,
    keys: list[Column],
    ranks: dict[Any, Callable[[int], list[int]]] | Callable[[int], list[int]],
    group: Column | None = None,
    tie: str = "row_id",
) -> dict[Any, list[Callable[[Column], Column]]]:
    """The same as functions of the first key, for callers that compute it once for all of them."""
    out: dict[Any, list[Callable[[Column], Column]]] = {}
    for g, cuts in order_cuts(df, keys[0], ranks, group).items():
        out[g] = []
        for rank, cut in sorted(cuts.items()):
            need = rank - cut.below
            if need == cut.equal:
                out[g].append(lambda key, edge=cut.value: key <= F.lit(edge))
            else:
                tied = keys[0] == F.lit(cut.value)
                inner = head_filter(df.where(_in_group(group, g) & tied), keys[1:], lambda n, need=need: need, tie=tie)
                out[g].append(lambda key, edge=cut.value, inner=inner: (key < F.lit(edge)) | ((key == F.lit(edge)) & inner))
    return out
