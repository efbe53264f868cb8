"""Host-level quality rules.

Each document is judged by rules on its whole text. The failures are summed by
host (here the ``source``), the failure rates of the hosts are shrunk towards
what all hosts show, with a beta prior fitted to their means and spread, and a
host whose shrunk rate exceeds ``max_rate`` takes its documents with it. A host
of few documents stays near the mean; one of many is judged by itself.

Repeated words are found within the row: hashes of all 8-word windows, and only
where two are equal a sort of (hash, place) pairs. The text is read once; the
staged measures are a few numbers per document. Hosts are joined back by a table
of one row per host, which the planner broadcasts or sort-merges by its measured
size; the prior is four sums.

Edge cases: null and empty texts have no words and fail; a null source is a host
of its own; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rareboost.session import stage

WS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SPAN, MIN_WORDS, MAX_REPEATED = 8, 20, 30


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda w: w != "")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return F.size(lines) - F.size(F.array_distinct(lines))


def window_hashes(words: Column) -> Column:
    """64-bit hash of every 8-word window; equality of windows is equality of hashes."""
    n = F.size(words)
    return F.when(n >= SPAN, F.transform(F.sequence(F.lit(1), n - (SPAN - 1)), lambda i: F.xxhash64(F.slice(words, i, SPAN)))).otherwise(
        F.array().cast("array<bigint>")
    )


def covered_words(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; windows overlap, words count once."""
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def same(s: Column) -> Column:
        return F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))

    # The sorted pairs are bound as a lambda variable, so that they are made once and not per element.
    starts = F.get(F.transform(F.array(F.array_sort(placed)), lambda s: F.array_sort(F.transform(same(s), lambda x: x["i"]))), F.lit(0))
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-SPAN).alias("last"))
    return F.aggregate(
        starts, first, lambda a, i: F.struct((a["n"] + F.least(F.lit(SPAN), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"]
    )


def measures(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The measures of every document, with ``base_failed``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(key).alias("_id"), F.col(host).alias("_host"), whole.alias("_t"), words_of(whole).alias("_w"))
    # Generated once per row: later expressions use these columns many times.
    split = split.select("_id", "_host", "_t", F.explode(F.array(F.struct("_w"))).alias("_x")).select("_id", "_host", "_t", F.col("_x._w").alias("_w"))
    hashed = split.select("_id", "_host", "_t", "_w", F.explode(F.array(F.struct(window_hashes(F.col("_w")).alias("h")))).alias("_x"))
    hashes = F.col("_x.h")
    repeats = F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered_words(hashes))
    out = hashed.select(
        "_id", "_host",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines(F.col("_t")).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def rule_failed() -> Column:
    """A document fails the host rules if it fails the base or shows junk of some other kind."""
    return (
        F.col("base_failed") | (10 * F.col("n_symbols") > F.col("word_chars"))
        | (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))
    )


def host_rates(measured: DataFrame, failed: Column) -> DataFrame:
    """One row per host: documents, failures, and the failure rate under an empirical beta prior."""
    hosts = stage(
        measured.groupBy("_host").agg(F.count("*").alias("n"), F.sum(failed.cast("long")).alias("k"))
    )  # one row per host
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    sums = hosts.agg(F.count("*").alias("h"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kk")).first()
    alpha, beta = beta_prior(sums["h"], sums["n"] or 0, sums["k"] or 0, sums["nn"] or 0.0, sums["kk"] or 0.0)
    return hosts.withColumn("rate", (k + alpha) / (n + (alpha + beta)))


def beta_prior(h: int, n: int, k: int, nn: float, kk: float) -> tuple[float, float]:
    """Method of moments over hosts weighted by their documents.

    h hosts, n documents, k failures, sums of n**2 and of k**2 / n. Without
    spread beyond chance the prior is worth all documents; without any failure,
    or nothing but failures, half a failure is put on either side.
    """
    if n == 0:
        return 1.0, 1.0
    mean = (k + 0.5) / (n + 1.0)
    between = kk - k * k / n - (h - 1) * mean * (1 - mean)
    spread = max(0.0, between / max(1e-9, n - nn / n)) if h > 1 else 0.0
    size = min(float(n), max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else float(n)
    return mean * size, (1 - mean) * size


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Measures, ``base_failed``, ``host_rate`` and ``kept`` of every document."""
    measured = stage(measures(docs, key=key, text=text, host=host))
    rates = host_rates(measured, rule_failed()).select(F.coalesce("_host", F.lit("")).alias("_name"), F.col("_host").isNull().alias("_none"), "rate")
    named = measured.withColumn("_name", F.coalesce("_host", F.lit(""))).withColumn("_none", F.col("_host").isNull())
    return named.join(rates, ["_name", "_none"]).select(
        F.col("_id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("rate").alias("host_rate"), (~F.col("base_failed") & (F.col("rate") <= max_rate)).alias("kept"),
    )
