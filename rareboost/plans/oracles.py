"""SQL texts of binning, histograms, tree growth and boosting for the second engine."""

from __future__ import annotations

from rareboost.plans.fixtures import FEATURES, LINES_SQL, N_BINS, hash_sql, sigmoid_sql, uniform_sql


def bins_sql(src: str, n_bins: int = N_BINS, features: list[str] | None = None, train: str | None = None) -> str:
    """CTEs ``vb`` (value to bin), ``thr`` (thresholds) and ``binned`` (src with b0, b1, ...)."""
    features = features or FEATURES
    train = train or src
    values = " UNION ALL ".join(
        f"SELECT {i} AS feature, CAST({f} AS DOUBLE) AS v FROM (SELECT DISTINCT {f} FROM {train})" for i, f in enumerate(features)
    )
    joins = " ".join(f"JOIN vb v{i} ON v{i}.feature = {i} AND v{i}.v = s.{f}" for i, f in enumerate(features))
    cols = ", ".join(f"v{i}.bin AS b{i}" for i in range(len(features)))
    return f"""vb AS MATERIALIZED (
  SELECT feature, v, CAST((r * least({n_bins}, n)) // n AS INTEGER) AS bin, least({n_bins}, n) AS nb FROM (
    SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY feature) AS n
    FROM ({values}))),
thr AS MATERIALIZED (
  SELECT feature, bin, CASE WHEN bin = max(nb) - 1 THEN 'infinity'::DOUBLE ELSE max(v) END AS upper
  FROM vb GROUP BY feature, bin),
binned AS MATERIALIZED (SELECT s.*, {cols} FROM {src} s {joins})"""


def cells_sql(src: str, n_features: int = len(FEATURES)) -> str:
    """Histogram of rows with node, b0.., g, h, w, y."""
    return " UNION ALL ".join(
        f"""SELECT node, {i} AS feature, b{i} AS bin, sum(g * w) AS sum_g, sum(h * w) AS sum_h, CAST(count(*) AS BIGINT) AS cnt,
  sum(CASE WHEN y > 0.5 THEN g * w ELSE 0 END) AS sum_g_pos, sum(CASE WHEN y > 0.5 THEN h * w ELSE 0 END) AS sum_h_pos,
  CAST(count(*) FILTER (y > 0.5) AS BIGINT) AS cnt_pos FROM {src} GROUP BY node, b{i}"""
        for i in range(n_features)
    )


def candidates_sql(cells: str, lam: float = 1.0, mcw: float = 1.0) -> str:
    return f"""SELECT *, gl * gl / (hl + {lam}e0) + gr * gr / (hr + {lam}e0) - (gl + gr) * (gl + gr) / (hl + hr + {lam}e0) AS gain,
  abs(pl / CAST(nl AS DOUBLE) - pr / CAST(nr AS DOUBLE)) AS purity FROM (
  SELECT *, gt - gl AS gr, ht - hl AS hr, nt - nl AS nr, pt - pl AS pr FROM (
    SELECT node, feature, bin, sum(sum_g) OVER l AS gl, sum(sum_h) OVER l AS hl,
      CAST(sum(cnt) OVER l AS BIGINT) AS nl, CAST(sum(cnt_pos) OVER l AS BIGINT) AS pl,
      sum(sum_g) OVER f AS gt, sum(sum_h) OVER f AS ht, CAST(sum(cnt) OVER f AS BIGINT) AS nt, CAST(sum(cnt_pos) OVER f AS BIGINT) AS pt
    FROM {cells} WINDOW f AS (PARTITION BY node, feature),
      l AS (PARTITION BY node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)))
  WHERE hl >= {mcw} AND hr >= {mcw} AND nl > 0 AND nr > 0"""


def best_sql(cells: str, lam: float = 1.0, mcw: float = 1.0, purity: float = 0.0) -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(score, 9) DESC, feature, bin) AS rn FROM (
    SELECT *, gain + {purity}e0 * purity AS score FROM ({candidates_sql(cells, lam, mcw)})) WHERE score > 0) WHERE rn = 1"""


def grow_sql(p: str, src: str, depth: int, lam: float = 1.0, mcw: float = 1.0, min_leaf: int = 20) -> str:
    """CTEs growing one tree on ``src`` (b0.., g, h, w, y); nodes are heap-numbered from 0.

    ``{p}_splits`` holds the splits, ``{p}_rows`` the sampled rows with their last node.
    A node that was not split meets the same test again on the next level and fails it again.
    """
    parts = [f"{p}_n0 AS MATERIALIZED (SELECT *, 0 AS node FROM {src})"]
    for d in range(depth):
        case = " ".join(f"WHEN {i} THEN b{i}" for i in range(len(FEATURES)))
        parts.append(f"{p}_c{d} AS MATERIALIZED ({cells_sql(f'{p}_n{d}')})")
        parts.append(f"""{p}_s{d} AS MATERIALIZED (
  SELECT b.* FROM ({best_sql(f'{p}_c{d}', lam, mcw)}) b JOIN (
    SELECT node FROM {p}_n{d} GROUP BY node HAVING count(*) >= {max(min_leaf, 2)} AND sum(h * w) >= {mcw}) USING (node)
  WHERE nl >= {min_leaf} AND nr >= {min_leaf})""")
        parts.append(f"""{p}_n{d + 1} AS MATERIALIZED (
  SELECT r.* EXCLUDE (node), CASE WHEN s.node IS NULL THEN r.node
    ELSE 2 * r.node + 1 + CAST((CASE s.feature {case} END) > s.bin AS INTEGER) END AS node
  FROM {p}_n{d} r LEFT JOIN {p}_s{d} s ON r.node = s.node)""")
    union = " UNION ".join(f"SELECT * FROM {p}_s{d}" for d in range(depth))
    parts.append(f"{p}_splits AS MATERIALIZED ({union})")
    parts.append(f"""{p}_leaves AS MATERIALIZED (
  SELECT node, CAST(row_number() OVER (ORDER BY {leaf_order_sql('node', depth)}) - 1 AS INTEGER) AS leaf, value, n FROM (
    SELECT node, -sum(g * w) / (sum(h * w) + {lam}e0) AS value, count(*) AS n FROM {p}_n{depth} GROUP BY node))""")
    return ",\n".join(parts)


def leaf_order_sql(node: str, depth: int) -> str:
    """Left-to-right key of a heap node: its left-most descendant on the last level."""
    whens = " ".join(
        f"WHEN {node} < {2 ** (d + 1) - 1} THEN ({node} + 1) * {2 ** (depth - d)}" for d in range(depth + 1)
    )
    return f"(CASE {whens} END)"


def route_sql(p: str, src: str, depth: int, out: str) -> str:
    """CTE ``out``: every row of ``src`` with the heap node reached by its bins."""
    case = " ".join(f"WHEN {i} THEN b{i}" for i in range(len(FEATURES)))
    sql = f"SELECT *, 0 AS node FROM {src}"
    for _ in range(depth):
        sql = f"""SELECT r.* EXCLUDE (node), CASE WHEN s.node IS NULL THEN r.node
    ELSE 2 * r.node + 1 + CAST((CASE s.feature {case} END) > s.bin AS INTEGER) END AS node
  FROM ({sql}) r LEFT JOIN {p}_splits s ON r.node = s.node"""
    return f"{out} AS MATERIALIZED ({sql})"


def leaf_table_sql(p: str, rows: str, lam: float = 1.0, k: int = 5) -> str:
    """CTEs ``{p}_stats`` and ``{p}_cal`` (node, value, prob) from rows with node, fold, g, h, y."""
    return f"""{p}_stats AS MATERIALIZED (
  SELECT node, fold, n, n_pos, CASE WHEN nt > n THEN gt - g ELSE 0 END AS sum_g, CASE WHEN nt > n THEN ht - h ELSE 0 END AS sum_h FROM (
    SELECT *, sum(g) OVER w AS gt, sum(h) OVER w AS ht, sum(n) OVER w AS nt FROM (
      SELECT node, fold, sum(g) AS g, sum(h) AS h, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (y > 0.5) AS BIGINT) AS n_pos
      FROM {rows} GROUP BY node, fold) WINDOW w AS (PARTITION BY node))),
{p}_vals AS MATERIALIZED (
  SELECT *, sum_h > 0 AS usable, CASE WHEN sum_h > 0 THEN -sum_g / (sum_h + {lam}e0) ELSE 0 END AS value,
    (n_pos + 10e0 * (SELECT greatest(least(avg(CAST(y > 0.5 AS INTEGER)), 0.9999e0), 0.0001e0) FROM {rows})) / (n + 10e0) AS rate
  FROM {p}_stats),
{p}_ord AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY value, fold) AS i, sum(value * n) OVER (PARTITION BY node)
    / sum(n) OVER (PARTITION BY node) AS mean_value FROM {p}_vals WHERE usable),
{p}_fit AS MATERIALIZED (
  SELECT node, i, max(low) AS fitted FROM (
    SELECT o.node, o.i, j, min(m) AS low FROM {p}_ord o JOIN (
      SELECT a.node, a.i AS j, b.i AS k, sum(c.rate * c.n) / sum(c.n) AS m FROM {p}_ord a JOIN {p}_ord b ON a.node = b.node AND a.i <= b.i
      JOIN {p}_ord c ON c.node = a.node AND c.i BETWEEN a.i AND b.i GROUP BY a.node, a.i, b.i) e
      ON e.node = o.node AND e.j <= o.i AND e.k >= o.i GROUP BY o.node, o.i, j) GROUP BY node, i),
{p}_cal AS MATERIALIZED (
  SELECT node, mean_value AS value, least(greatest(fitted, 0), 1) AS prob FROM (
    SELECT o.node, mean_value, f.fitted, row_number() OVER (PARTITION BY o.node ORDER BY abs(o.value - mean_value), o.i) AS rn
    FROM {p}_ord o JOIN {p}_fit f ON f.node = o.node AND f.i = o.i) WHERE rn = 1)"""


def folds_sql(src: str, k: int, seed: int = 42, out: str = "folded") -> str:
    """CTE with stratified folds: each class in hash order, cut into k stacks."""
    return f"""{out} AS MATERIALIZED (
  SELECT * EXCLUDE (pos, rn, n), {stack_sql('rn', 'n', k)} AS fold FROM (
    SELECT *, row_number() OVER (PARTITION BY pos ORDER BY hs, row_id) - 1 AS rn, count(*) OVER (PARTITION BY pos) AS n FROM (
      SELECT *, y > 0.5 AS pos, {hash_sql('strata', seed)} AS hs
      FROM {src})))"""


def stack_sql(rn: str, n: str, k: int) -> str:
    """Stack number of 0-based position rn when the first n mod k stacks hold one row more."""
    big = f"(({n} // {k} + 1) * ({n} % {k}))"
    return (
        f"CAST(CASE WHEN {rn} < {big} THEN {rn} // ({n} // {k} + 1) "
        f"ELSE {n} % {k} + ({rn} - {big}) // greatest({n} // {k}, 1) END AS INTEGER)"
    )


# The demonstration model of the scoring queries: two trees of depth two, sampled
# uniformly, with leaf calibration. Mirrors plans.models.DEMO.
DEMO_DEPTH, DEMO_RATE, DEMO_LR, DEMO_K = 2, 0.8, 0.3, 5


def boost_sql(rounds: int = 2, depth: int = DEMO_DEPTH, calibrate: bool = True) -> str:
    """CTEs ``state{r}`` (rows with pred), ``t{r}_*`` (trees); ends with ``state{rounds}``."""
    parts = [LINES_SQL]
    parts.append(folds_sql("lines", DEMO_K))
    parts.append(bins_sql("folded"))
    return ",\n".join([*parts, *rounds_sql(rounds, depth, calibrate)])


def rounds_sql(rounds: int = 2, depth: int = DEMO_DEPTH, calibrate: bool = True) -> list[str]:
    """CTEs ``state0`` to ``state{rounds}`` and ``t{r}_*`` that boost the rows of ``binned``."""
    parts = ["state0 AS MATERIALIZED (SELECT *, (SELECT ln(avg(y) / (1 - avg(y))) FROM binned) AS pred FROM binned)"]
    for r in range(rounds):
        parts.append(
            f"work{r} AS MATERIALIZED (SELECT *, pr - y AS g, greatest(pr * (1 - pr), 1e-7) AS h, {1 / DEMO_RATE}e0 AS w "
            f"FROM (SELECT *, {sigmoid_sql('pred')} AS pr FROM state{r}))"
        )
        parts.append(f"sample{r} AS MATERIALIZED (SELECT * FROM work{r} WHERE {uniform_sql('uniform', 42, r)} < {DEMO_RATE}e0)")
        parts.append(grow_sql(f"t{r}", f"sample{r}", depth))
        parts.append(route_sql(f"t{r}", f"work{r}", depth, f"routed{r}"))
        if calibrate:
            parts.append(leaf_table_sql(f"t{r}", f"routed{r}", k=DEMO_K))
            leaf = f"SELECT l.node, l.leaf, l.n, coalesce(c.value, l.value) AS value, coalesce(c.prob, 0) AS prob FROM t{r}_leaves l LEFT JOIN t{r}_cal c USING (node)"
        else:
            leaf = f"SELECT node, leaf, n, value, 0.0::DOUBLE AS prob FROM t{r}_leaves"
        parts.append(f"t{r}_final AS MATERIALIZED ({leaf})")
        parts.append(
            f"state{r + 1} AS MATERIALIZED (SELECT q.* EXCLUDE (pred, pr, g, h, w, node), pred + {DEMO_LR}e0 * f.value AS pred, "
            f"f.leaf AS leaf{r}, f.value AS value{r}, f.prob AS prob{r} FROM routed{r} q JOIN t{r}_final f USING (node))"
        )
    return parts


def held_out_sql(rounds: int = 2, depth: int = DEMO_DEPTH, k: int = DEMO_K) -> str:
    """CTEs ``folded`` and ``held_out`` (row_id, y, fold, score): each fold scored by an uncalibrated model of the other folds.

    A fold's model lives in a nested WITH, so that all of them use the same names.
    """
    ends = ", ".join(f"list(upper ORDER BY bin) FILTER (feature = {i}) AS u{i}" for i in range(len(FEATURES)))
    bins = ", ".join(f"len(list_filter(u{i}, lambda x: x < {f})) AS b{i}" for i, f in enumerate(FEATURES))
    models = []
    for fold in range(k):
        parts = [
            f"others AS MATERIALIZED (SELECT * FROM folded WHERE fold <> {fold})", bins_sql("others"), *rounds_sql(rounds, depth, False),
            f"ends AS MATERIALIZED (SELECT {ends} FROM thr)",
            f"held0 AS MATERIALIZED (SELECT row_id, y, fold, {bins}, (SELECT min(pred) FROM state0) AS score FROM folded, ends WHERE fold = {fold})",
        ]
        for r in range(rounds):
            parts.append(route_sql(f"t{r}", f"held{r}", depth, f"reached{r}"))
            parts.append(
                f"held{r + 1} AS MATERIALIZED (SELECT q.* EXCLUDE (node, score), score + {DEMO_LR}e0 * f.value AS score "
                f"FROM reached{r} q JOIN t{r}_final f USING (node))"
            )
        models.append(f"SELECT * FROM (WITH {', '.join(parts)} SELECT row_id, y, fold, score FROM held{rounds})")
    return ",\n".join([LINES_SQL, folds_sql("lines", k), f"held_out AS MATERIALIZED ({' UNION ALL '.join(models)})"])


def isotonic_sql(src: str, score: str, label: str = "y") -> str:
    """CTEs ``pts`` (distinct scores), ``iso`` (fitted values, max-min form) and ``bps`` (breakpoints)."""
    return f"""pts AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY score) - 1 AS i, sum(y * w) OVER (ORDER BY score) AS sy, sum(w) OVER (ORDER BY score) AS sw FROM (
    SELECT min({score}) AS score, avg({label}) AS y, CAST(count(*) AS DOUBLE) AS w FROM {src} GROUP BY round({score}, 9))),
iso AS MATERIALIZED (
  SELECT p.i, p.score, p.y, p.w, least(greatest(f.fitted, 0), 1) AS fitted FROM pts p JOIN (
    SELECT k AS i, max(low) AS fitted FROM (
      SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS low FROM (
        SELECT a.i AS j, b.i AS k, (b.sy - a.sy + a.y * a.w) / (b.sw - a.sw + a.w) AS m FROM pts a JOIN pts b ON b.i >= a.i))
    GROUP BY k) f USING (i)),
blk AS MATERIALIZED (
  SELECT *, CAST(sum(starts) OVER (ORDER BY i) - 1 AS INTEGER) AS block FROM (
    SELECT *, CASE WHEN abs(fitted - lag(fitted) OVER (ORDER BY i)) < 1e-9 THEN 0 ELSE 1 END AS starts FROM iso)),
bps AS MATERIALIZED (
  SELECT CAST(block * 3 + part AS INTEGER) AS seq, b.score, prob FROM (
    SELECT block, unnest(CASE WHEN hi > lo THEN [lo, (lo + hi) // 2, hi] ELSE [lo] END) AS i,
      unnest(CASE WHEN hi > lo THEN [0, 1, 2] ELSE [0] END) AS part, prob FROM (
        SELECT block, min(i) AS lo, max(i) AS hi, min(fitted) AS prob FROM blk GROUP BY block)) JOIN (SELECT i, score FROM pts) b USING (i))"""


def isotonic_apply_sql(src: str, score: str, out: str) -> str:
    """CTE ``out``: src with ``prob`` interpolated between the breakpoints ``bps``."""
    return f"""{out} AS MATERIALIZED (
  SELECT *, CASE WHEN {score} <= s0 THEN p0 WHEN {score} >= s9 THEN p9
    ELSE least(greatest(pl + ({score} - sl) / (sh - sl + 1e-9) * (ph - pl), 0), 1) END AS prob FROM (
    SELECT s.*, lo.score AS sl, lo.prob AS pl, hi.score AS sh, hi.prob AS ph, e.* FROM {src} s
    LEFT JOIN (SELECT v, max(l.seq) AS ls FROM (SELECT DISTINCT {score} AS v FROM {src}) JOIN bps l ON l.score < v GROUP BY v) x ON x.v = s.{score}
    LEFT JOIN (SELECT v, min(h.seq) AS hs FROM (SELECT DISTINCT {score} AS v FROM {src}) JOIN bps h ON h.score >= v GROUP BY v) z ON z.v = s.{score}
    LEFT JOIN bps lo ON lo.seq = x.ls LEFT JOIN bps hi ON hi.seq = z.hs
    CROSS JOIN (SELECT arg_min(score, seq) AS s0, arg_min(prob, seq) AS p0, arg_max(score, seq) AS s9, arg_max(prob, seq) AS p9 FROM bps) e))"""
