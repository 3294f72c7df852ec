"""URL filters: rules and parts by hand, the levels against a plain computation, the query against DuckDB."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from trackframe.llm import reputation
from trackframe.llm.queries import ORACLES, op11_url_filters


def test_query_equals_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert same(op11_url_filters(spark, sf), ORACLES["op11_url_filters"], sf) > 0


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def test_parts_and_rules(spark):
    urls = [
        None, "", "no scheme/x", "http://", "://", "HTTP://A.COM", "http://Ä.COM/", "http://x.com/en/", "http://com/", "http://com", "http://xcom/", "https://example.com/en/1?q=/fr/", "https://m.example.com/en/1",
        "https://www.example.com/en/", "https://a.www.example.com/en/x", "https://www.example.com/fr/", "http://a.net/es/", "http://a.net/es", "http://a.net/fr/#x", "http://a.net?/es/", "http://a.net/#/es/", "a://b://c.com/", "http://x.com:80/en/", "http://a\nb.com/x\ny",
    ]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)] + [(None, urls[7], "h", 1), (7, urls[7], "h", 1)], "page_id long, url string, host string, n long")
    none = spark.createDataFrame([], "url string, bad boolean")
    rows = reputation.judge(pages, none).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        url = urls[r.id if r.id is not None else 7]
        host, path = parts(url)
        fit = [x for x in reputation.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.host + x.path), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best.host + best.path, best.verdict if best else "allow"), url
        assert (r.n_labelled, r.n_bad, r.bad_rate) == (0, 0, pytest.approx(0.5))
    assert reputation.judge(pages.limit(0), none).count() == 0


@pytest.mark.parametrize(
    ("host", "suffix", "domain"),
    [("a.b.co.uk", "co.uk", "b.co.uk"), ("co.uk", "co.uk", "co.uk"), ("x.de", "de", "x.de"), ("de", "de", "de"), ("10.0.0.1", "10.0.0.1", "10.0.0.1"), ("u@w.a.com:80", "com", "a.com"), ("a.com.", "com", "a.com"), ("", "", ""), ("[::1]", "[::1]", "[::1]"), ("a.co.b.com", "com", "b.com")],
)
def test_names(spark, host, suffix, domain):
    bare = reputation._bare(F.col("h"))
    assert tuple(spark.createDataFrame([(host,)], "h string").select(reputation.suffix_of(bare), reputation.domain_of(bare)).first()) == (suffix, domain)


def tail(a, b, limit):
    """The beta distribution's share above the limit, by summing its density over the logit."""
    reach = 60 / min(a, b, 1) + 5
    u = np.linspace(-reach, reach, 2_000_001)
    log = -np.logaddexp(0, -u) * a - np.logaddexp(0, u) * b
    w = np.exp(log - log.max())
    at = np.log(limit / (1 - limit))
    return (w[u > at].sum() + w[u >= at].sum()) / 2 / w.sum()


def test_beta_tail(spark):
    cases = [(0.3, 0.9, 0.5), (1.0, 1.0, 0.3), (3.0, 1.5, 0.5), (240.0, 760.0, 0.25), (0.05, 0.2, 0.5), (500.0, 2.0, 0.99), (2000.0, 2000.0, 0.5)]
    for a, b, limit in cases:
        got = spark.createDataFrame([(a, b)], "a double, b double").select(reputation.beta_above(F.col("a"), F.col("b"), limit)).first()[0]
        assert got == pytest.approx(tail(a, b, limit), abs=2e-4), (a, b, limit)
    large = spark.createDataFrame([(4e7, 6e7)], "a double, b double").select(reputation.beta_above(F.col("a"), F.col("b"), 0.4)).first()[0]
    assert large == pytest.approx(0.5, abs=1e-3)


def strength(groups, parent):
    """The moment estimator over (parent, n, y)."""
    by = defaultdict(list)
    for g, (n, y) in groups.items():
        if n:
            by[parent(g)].append((n, y))
    spread = room = 0.0
    for xs in by.values():
        if len(xs) > 1:
            n, y = map(sum, zip(*xs, strict=True))
            m = y / n
            spread += sum(a * (b / a - m) ** 2 for a, b in xs) - (len(xs) - 1) * m * (1 - m)
            room += (n - sum(a * a for a, _ in xs) / n - len(xs) + 1) * m * (1 - m)
    if room <= 0:
        return reputation.UNKNOWN
    share = min(max(spread / room, 1 / (1 + reputation.MOST)), 1 / (1 + reputation.LEAST))
    return (1 - share) / share


def test_levels_equal_a_plain_computation_and_bad_hosts_go(spark):
    rnd, outcomes, pages = random.Random(8), [], []
    for s in ("com", "net", "co.uk"):
        for d in range(12):
            rate = rnd.betavariate(1, 3)
            for h in range(rnd.randint(1, 4)):
                host, worse = f"h{h}.d{d}.{s}", min(0.97, rate + rnd.choice([0, 0, 0.7]))
                outcomes += [(f"http://{host}/p{k}", rnd.random() < worse) for k in range(rnd.choice([0, 1, 5, 40]))]
                pages.append((len(pages), f"http://{host}/x"))
    outcomes += [(None, True), ("http://h0.d0.com/", None), ("nothing", True), ("http://unseen.d1.net/", True), ("http://h0.d0.com/", False), ("http://h0.d0.com/", False)]
    pages += [(900, "http://new.d3.com/"), (901, "http://a.b.unknown/"), (902, None)]
    counts = defaultdict(lambda: [0, 0])
    for url, bad in outcomes:
        if bad is not None and parts(url)[0]:
            counts[parts(url)[0]][0] += 1
            counts[parts(url)[0]][1] += bad
    for _, url in pages:
        counts[parts(url)[0]] += []
    suffix = lambda h: "co.uk" if h.endswith(".co.uk") else h.rsplit(".", 1)[-1]
    domain = lambda h: ".".join(h.split(".")[-1 - len(suffix(h).split(".")) :])

    def up(groups, name):
        out = defaultdict(lambda: [0, 0])
        for g, (n, y) in groups.items():
            out[name(g)][0] += n
            out[name(g)][1] += y
        return out

    domains = up(counts, domain)
    suffixes = up(domains, suffix)
    w0, w1, w2 = strength(suffixes, lambda g: 0), strength(domains, suffix), strength(counts, domain)
    n, y = map(sum, zip(*suffixes.values(), strict=True))
    top = {s: (b + w0 * (y + 0.5) / (n + 1)) / (a + w0) for s, (a, b) in suffixes.items()}
    middle = {d: (b + w1 * top[suffix(d)]) / (a + w1) for d, (a, b) in domains.items()}
    frame = spark.createDataFrame(pages, "page_id long, url string")
    blocked = 0
    for r in reputation.judge(frame, spark.createDataFrame(outcomes, "url string, bad boolean"), rules=()).collect():
        a, b = counts[r.host]
        alpha, beta = b + w2 * middle[domain(r.host)], a - b + w2 * (1 - middle[domain(r.host)])
        above = tail(alpha, beta, reputation.LIMIT)
        assert (r.n_labelled, r.n_bad, r.rule) == (a, b, None)
        assert r.bad_rate == pytest.approx(alpha / (alpha + beta)) and r.above_limit == pytest.approx(above, abs=2e-4)
        if abs(above - reputation.SURE) > 1e-3:
            assert r.verdict == ("block" if above > reputation.SURE else "allow")
        blocked += r.verdict == "block"
        if a >= 40 and b / a > 0.75:
            assert r.verdict == "block"
        if a >= 40 and b / a < 0.4:
            assert r.verdict == "allow"
    assert 0 < blocked < len(pages) / 2


def test_outcomes_by_number(spark):
    pages = spark.createDataFrame([(0, "http://a.com/en/5"), (1, "http://b.com/de/5?x"), (2, "http://a.com/en/99999999999999999999"), (3, None), (4, "http://a.com/en/x"), (5, "http://a.com/en/6"), (6, "http://a.com/en/7")], "page_id long, url string")
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 1), (6, 1, None), (7, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, reputation.numbered_outcomes(pages, labels).collect())) == [("http://a.com/en/5", True), ("http://a.com/en/7", True), ("http://b.com/de/5?x", True)]
