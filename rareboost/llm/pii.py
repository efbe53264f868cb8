"""Personal data: base patterns, and weakly supervised spans beside them.

Emails, IP addresses, card and phone numbers follow fixed patterns with checks
and are always reported. Further spans come from candidates, tokens with three
or more digits, on which labelers vote for, against or not at all:

* regex: the shape of the token (long hexadecimal runs, grouped digits; short
  plain numbers speak against),
* gazetteer: listed words inside the token (key names, country codes of
  accounts; units and web words speak against),
* context: listed words in the 24 characters before it.

Expectation-maximisation over the counts of vote patterns, a table of at most 27
rows, estimates how reliable each labeler is and how likely each pattern is a
personal span. A logistic classifier on the features of the span alone is then
fitted to these probabilities (again on counts, at most 2**FEATURES times 27
rows) and decides; it reaches spans on which no labeler votes.

Everything runs in one narrow pass over the texts, which stages a few spans per
document, one grouped count, and one pass over the staged spans. Places are code
points, found by splitting a text at its matches. The work per document is
linear in its length, plus the square of its few matches.

Edge cases: null texts are empty; documents without spans report empty strings;
repeated rows are reported each; with no candidates the classifier adds nothing;
an empty table gives no rows. Input columns named like a result are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rareboost.session import stage

KINDS = ("email", "ip", "card", "phone")
ADDED = "other"
#: The contract's patterns, with possessive loops (nothing after a loop could match what it gave back) and searches that
#: start at the head of a run or at the end of the last match, so that long runs are read once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![^\x20\x09-\x0D])(?=(?:[^\x20\x09-\x0D0-9]*+[0-9]){3})[^\x20\x09-\x0D]{6,}+"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SHAPE_FOR = r"[0-9a-fA-F]{16,}|^\(?[0-9]{3}\)?[.-][0-9]{3}[.-][0-9]{4}|^[A-Z]{2}[0-9]{12,}"
SHAPE_AGAINST = r"^[0-9]{1,8}[.,;:!?)]*$|^[0-9]{1,3}(?:[.,][0-9]{3})+[.,;:!?)]*$"
WORDS_FOR = r"(?i)passw|token|secret|api|key|pwd|iban|ssn"
WORDS_AGAINST = r"(?i)http|www|html|version|isbn|px|kg|km"
CONTEXT_FOR = r"(?:passw\w*|token|secret|key|login|call|tel|phone|mail|card|account|iban|ssn)\W*$"
CONTEXT_AGAINST = r"(?:page|chapter|version|figure|fig|table|no|nr|vol|year)\W*$"
FEATURES = 6
SPAN = "array<struct<s:int,e:int,m:string,c:string>>"


def located(text: Column, pattern: str, context: bool = False) -> Column:
    """Every match with its code point range, leftmost and without overlaps, and the text before it."""
    lit = F.lit(pattern)
    pieces = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, lit, F.lit(0)),
        lambda p, m: F.struct(F.length(p).alias("g"), m.alias("m"), (F.lower(F.right(p, F.lit(24))) if context else F.lit("")).alias("c")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(a: Column, x: Column) -> Column:
        begin = a["at"] + x["g"]
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(begin.alias("s"), end.alias("e"), x["m"].alias("m"), x["c"].alias("c"))).cast(SPAN)
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), a["out"]).otherwise(F.concat(a["out"], one)).alias("out"))

    return F.aggregate(pieces, start, add, lambda a: a["out"])


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    total = F.lit(0)
    for k in range(19):
        d = F.coalesce(F.try_to_number(F.substring(back, k + 1, 1), F.lit("9")).cast("int"), F.lit(0))
        total = total + (d if k % 2 == 0 else 2 * d - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The check that a match of a kind must pass."""
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        digits = F.translate(m, " -", "")
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(F.translate(m, "+ ().-", "")).between(9, 15)
    return F.lit(True)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def _vote(for_: Column, against: Column) -> Column:
    return F.when(for_, 1).when(against, -1).otherwise(0)


def _features(m: Column, c: Column) -> Column:
    """Feature bits of a span: long, mostly digits, a sign of assignment, hexadecimal, mixed case or letters, a cue before it."""
    bits = [
        F.length(m) >= 14, 2 * F.length(F.translate(m, "0123456789", "")) < F.length(m), m.rlike("[=:]"), m.rlike("[0-9a-f]{12,}"),
        m.rlike("[A-Za-z]"), c.rlike(r"[=:\"]\s*$"),
    ]
    total = F.lit(0)
    for k, b in enumerate(bits):
        total = total + F.when(b, 1 << k).otherwise(0)
    return total


def spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the spans of each base kind, and the candidates with votes and features."""
    t = F.coalesce(F.col(text), F.lit(""))
    quick = {"email": F.instr(t, "@") > 0, "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9](?:[ -]?[0-9]){12}"), "phone": F.instr(t, "+") > 0}
    none = F.array().cast(SPAN)

    def base(kind: str) -> Column:
        return F.when(quick[kind], F.filter(located(t, PATTERNS[kind]), lambda x: valid(kind, x["m"]))).otherwise(none).alias(kind)

    found = docs.select(
        F.col(key).alias("_id"),
        *[base(k) for k in KINDS],
        F.when(t.rlike("[0-9]"), located(t, CANDIDATE, context=True)).otherwise(none).alias("_c"),
    )
    voted = F.transform(
        "_c",
        lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"),
            _vote(x["m"].rlike(SHAPE_FOR), x["m"].rlike(SHAPE_AGAINST)).alias("shape"),
            _vote(x["m"].rlike(WORDS_FOR), x["m"].rlike(WORDS_AGAINST)).alias("words"),
            _vote(x["c"].rlike(CONTEXT_FOR), x["c"].rlike(CONTEXT_AGAINST)).alias("context"),
            _features(x["m"], x["c"]).alias("f"),
        ),
    )
    return found.select("_id", *[_bare(F.col(k)).alias(k) for k in KINDS], voted.alias("_c"))


@dataclass
class Reliability:
    """Share of personal spans, and for each labeler and class the chance of each vote."""

    prior: float
    votes: list[dict[int, tuple[float, float]]]

    def posterior(self, pattern: tuple[int, ...]) -> float:
        """Chance that a span with these votes is personal."""
        a, b = self.prior, 1 - self.prior
        for table, v in zip(self.votes, pattern):
            a, b = a * table[v][0], b * table[v][1]
        return a / (a + b)


def expectation_maximisation(counts: dict[tuple[int, ...], int], rounds: int = 50) -> Reliability:
    """Reliabilities of the labelers from how often each vote pattern occurs; no truth is known.

    Starts from labelers that are right more often than not; one pseudo-count
    per cell keeps votes that never occur possible.
    """
    n = len(next(iter(counts)))
    right = {1: (0.5, 0.1), 0: (0.4, 0.4), -1: (0.1, 0.5)}
    model = Reliability(0.3, [dict(right) for _ in range(n)])
    for _ in range(rounds):
        belief = {p: model.posterior(p) for p in counts}
        yes = sum(c * belief[p] for p, c in counts.items())
        no = sum(counts.values()) - yes
        votes = []
        for k in range(n):
            table = {}
            for v in (-1, 0, 1):
                a = sum(c * belief[p] for p, c in counts.items() if p[k] == v)
                b = sum(c * (1 - belief[p]) for p, c in counts.items() if p[k] == v)
                table[v] = ((a + 1) / (yes + 3), (b + 1) / (no + 3))
            votes.append(table)
        model = Reliability((yes + 1) / (yes + no + 2), votes)
    return model


def fit_classifier(rows: list[tuple[int, float, float]], rounds: int = 400, rate: float = 0.5) -> list[float]:
    """Logistic regression of (feature bits, weight, probability); returns the probability for each feature pattern."""
    w, total = [0.0] * (FEATURES + 1), sum(n for _, n, _ in rows)
    spread = [[1.0, *[float(f >> k & 1) for k in range(FEATURES)]] for f in range(1 << FEATURES)]

    def chance(f: int) -> float:
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, spread[f]))))

    for _ in range(rounds if total else 0):
        slope = [0.0] * len(w)
        for f, n, p in rows:
            miss = n / total * (p - chance(f))
            slope = [s + miss * x for s, x in zip(slope, spread[f])]
        w = [a + rate * s * 4 for a, s in zip(w, slope)]
    return [chance(f) if total else 0.0 for f in range(1 << FEATURES)]


def learn(found: DataFrame) -> list[float]:
    """Probability of a personal span for every feature pattern, from the votes on all candidates."""
    votes = ["shape", "words", "context"]
    rows = found.select(F.explode("_c").alias("x")).groupBy("x.f", *[f"x.{v}" for v in votes]).count().collect()  # at most 2**FEATURES * 27
    if not rows:
        return fit_classifier([])
    counts: dict[tuple[int, ...], int] = {}
    for r in rows:
        p = tuple(r[v] for v in votes)
        counts[p] = counts.get(p, 0) + r["count"]
    model = expectation_maximisation(counts)
    return fit_classifier([(r["f"], float(r["count"]), model.posterior(tuple(r[v] for v in votes))) for r in rows])


def _named(kind: str, spans_: Column) -> Column:
    return F.transform(spans_, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def find_pii(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans of every document."""
    found = stage(spans(docs, key=key, text=text))
    accept = F.lit([p >= threshold for p in learn(found)])
    base = F.concat(*[F.col(k) for k in KINDS])
    added = F.filter(
        "_c", lambda x: F.element_at(accept, x["f"] + 1) & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    )  # spans that the base already reports are not repeated
    named = found.select("*", F.concat(*[_named(k, F.col(k)) for k in KINDS]).alias("_base"), added.alias("_added"))
    return named.select(
        F.col("_id").alias(key), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.concat_ws(",", "_base").cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat("_base", _named(ADDED, F.col("_added")))).alias("spans"),
    )
