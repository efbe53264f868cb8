"""Native row operators on edge texts, against plain Python."""

import hashlib
import re

import pytest

from rareboost.llm import pii, quality_rules, url_filter
from rareboost.llm.query_url_filter import RULES
from tests.llm.brute import SPACE

TEXTS = [
    None, "", " \n\t", "one", "a b c d e f g h " * 12, "x y\nx y\n\n \nx y\x0bz", "# $ % & | < > * é𝄞 \x85 \u00a0b", "w " * 40_000,
    " ".join(f"u{i}" for i in range(30)) + " k l m n o p q r s k l m n o p q r s", "a b c d e f g h", "line\r\nline\r\nline",
]


def measure(text):
    t = text or ""
    w = SPACE.findall(t)
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {k for i in places for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_measures(spark):
    df = spark.createDataFrame([(i, t, None if i % 2 else "h", "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, n_words string")
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality_rules.judge(df).collect()}
    assert got == {i: measure(t) for i, t in enumerate(TEXTS)}
    assert quality_rules.judge(df.where("false")).count() == 0


def test_bad_hosts_take_their_documents(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 10 == 0 else "junk", "bad") for i in range(200)] + [(1000 + i, good, "good") for i in range(200)] + [(5000, good, "new"), (5001, "junk", "small")]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i]["kept"] for i in range(200)) and all(got[1000 + i]["kept"] for i in range(200)) and got[5000]["kept"]
    assert 0.2 < got[5000]["host_rate"] < 0.5 < got[5001]["host_rate"] < got[0]["host_rate"]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = {k: [m.span() for m in re.finditer(p, text or "") if holds(k, m.group())] for k, p in PATTERNS.items()}
    named = ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans)
    return (*map(len, found.values()), hashlib.sha256(named.encode()).hexdigest()), named


def test_base_spans(spark, sf):
    texts = [
        None, "", "é a@b.co.d@e.fr a@b.com_x@y.org. A@b", "1.2.3.4.5.6.7.8 999.1.1.1 00255.0.0.1 256.1.1.1 0.0.0.0",
        "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 4111  1111", "𝄞 +1 (555) 555-0000 x+12 345 6. ++49 30 1234567 +1 ( 2",
        "1" * 5000 + " " + "1." * 5000 + "a@" + "b." * 3000, "a" * 20_000 + "@", "+1" + " (" * 3000,
    ]
    rows = list(enumerate(texts)) + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        numbers, named = base(text)
        assert tuple(got[i])[1:6] == numbers, (i, text)
        assert got[i]["spans"].startswith(named)
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_weak_labels_find_secrets(spark):
    rows = [(i, f"lorem ipsum password={hashlib.md5(b"%d" % i).hexdigest()[:18]} dolor {i} and 12345 sit") for i in range(60)] + [(100, "deadbeefdeadbeef0123 alone"), (101, "in 2024 there were 123456 items")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == "other:12:39" for i in range(60)) and got[100].startswith("other:0:") and got[101] == ""


def test_expectation_maximisation_trusts_agreement():
    counts = {(1, 1, 0): 300, (-1, -1, 0): 600, (1, 1, -1): 20, (1, 1, 1): 20, (-1, -1, 1): 40, (-1, -1, -1): 40}
    model = pii.expectation_maximisation(counts)
    assert model.posterior((1, 1, -1)) > 0.9 > 0.1 > model.posterior((-1, -1, 1)) and model.prior == pytest.approx(1 / 3, abs=0.05)


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, "allow"
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


URLS = [
    None, "", "no scheme/com", "http://", "https:///en/", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://a.b.example.com/en/?q#f",
    "http://notexample.com/en/", "http://com/", "http://com", "http://com.", "http://x.net/es/a", "http://net/fr/", "http://x.net/FR/", "http://a.net/es",
    "http://u@x.com:80/", "ftp://x.org/a://b.com/", "http://" + "a." * 5000 + "com/x", "http://É.com/en/\n/x", "://x.net/es/", "http://x.net?/es/", "http://x.net/es/",
]


def test_url_verdicts(spark):
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)] + [(0, None, "again")], "page_id long, url string, host string")
    got = url_filter.judge(df, RULES)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(URLS[r["page_id"]])
    assert url_filter.judge(df.where("false"), RULES).count() == 0
    assert url_filter.judge(df, []).where("verdict <> 'allow' or rule is not null").count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(5000)]
    listed = keys[::17]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = url_filter.build_cascade(universe, listed)
    assert len(cascade.levels) > 2
    assert sorted(r["key"] for r in universe.where(cascade.listed(universe["key"])).collect()) == sorted(listed)
