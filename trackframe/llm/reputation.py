"""URL filters: written rules first, then what labelled pages say about a host.

A host's rate of bad outcomes is shrunk by empirical Bayes, level by level: the suffix's rate towards that of all
outcomes, the registered domain's towards its suffix's, the host's towards its domain's. Each level has a beta prior
around the level above; its strength comes from how much the level's groups really differ (a moment estimator of the
beta-binomial's overdispersion), so levels that tell nothing pull hard and levels that differ pull little. A host
without outcomes has its domain's rate, one of an unknown domain its suffix's. A host is blocked if the lower bound of its posterior lies
above the limit: the posterior, a beta distribution, has at least ``SURE`` of its mass there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import join_unique, let, materialize, remove

#: Blocked: at least this share of the posterior lies above this rate of bad outcomes.
SURE, LIMIT = 0.95, 0.5
#: A prior weighs at least and at most so many outcomes; so many if no parent has two groups to compare.
LEAST, MOST, UNKNOWN = 1.0, 1000.0, 10.0

#: Labels below a country's domain under which names are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "go", "mil", "ne", "net", "nom", "or", "org")


class Rule(NamedTuple):
    """``verdict`` (allow or block) for a host with all its subdomains, where the path begins with ``path``."""

    verdict: str
    host: str
    path: str


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))

_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z in lower case; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The part of a host under which names are registered: its last label, or two as in ``co.uk``; an address of numbers as it is."""
    two = rf"(?:\A|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})\z"
    return F.when(F.rlike(host, F.lit(r"\A[0-9.]*\z|[\[\]]")), host).when(F.rlike(host, F.lit(two)), F.regexp_extract(host, two, 1)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and the label before it, if there is one."""
    labels = lambda c: F.size(F.split(c, r"\.", -1))
    return let(suffix_of(host), lambda s: F.when(s == host, host).otherwise(F.array_join(F.slice(F.split(host, r"\.", -1), -1 - labels(s), labels(s) + 1), ".")))


def _bare(host: Column) -> Column:
    """A host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"\A.*@", ""), r"\.?(?::[0-9]*)?\z", "")


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, null if none does; of rules of one length a blocking one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "block")):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.host + r.path).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _log_gamma(z: Column) -> Column:
    """Stirling's series eight places further on."""
    w = z + 8.0
    series = (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12.0 * w) - 1 / (360.0 * w * w * w) + 1 / (1260.0 * w * w * w * w * w)
    below = z
    for k in range(1, 8):
        below = below * (z + float(k))
    return series - F.log(below)


def beta_above(a: Column, b: Column, limit: float) -> Column:
    """The share of a beta distribution above ``limit``, by the continued fraction of the incomplete beta function.

    It takes some multiple of the square root of ``a + b`` steps, so no size needs another way.
    """
    flipped = F.lit(limit) >= (a + 1.0) / (a + b + 2.0)
    pick = lambda one, other: F.when(flipped, one).otherwise(other)
    given = F.struct(pick(b, a).alias("p"), pick(a, b).alias("q"), pick(F.lit(1 - limit), F.lit(limit)).alias("x"), flipped.alias("flipped"))

    def share(v: Column) -> Column:
        p, q, x = v["p"], v["q"], v["x"]

        def coefficient(k: Column) -> Column:
            m = F.floor(k / 2).cast("double")
            even, odd = m * (q - m), -(p + m) * (p + q + m)
            return F.when(k % 2 == 0, even).otherwise(odd) * x / ((p + k - 1.0) * (p + k))

        def step(acc: Column, k: Column) -> Column:
            return let(coefficient(k), lambda e: let(1.0 / (1.0 + e * acc["d"]), lambda d: let(1.0 + e / acc["c"], lambda c: F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h")))))

        d = 1.0 / (1.0 - (p + q) * x / (p + 1.0))
        steps = F.sequence(F.lit(2), (60 + 6 * F.sqrt(p + q)).cast("int"))
        fraction = F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")), step)["h"]
        front = F.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * F.log(x) + q * F.log(1.0 - x)) / p
        return F.when(v["flipped"], front * fraction).otherwise(1.0 - front * fraction)

    return let(given, share)


def numbered_outcomes(pages: DataFrame, labels: DataFrame, url_col: str = "url", key_col: str = "doc_id", good_col: str = "quality", bad_col: str = "toxic") -> DataFrame:
    """(url, bad) of pages whose path ends in a labelled document's number after one word, as in ``/en/7817``.

    A document is bad if it is of no quality or toxic; of repeated labels the worse counts. Labels without a number or without
    either judgement are none. A document that many pages show is joined by a bounded broadcast.
    """
    number = F.regexp_extract(path_of(F.col(url_col).cast("string")), r"\A/[a-z]+/([0-9]+)", 1)
    told = labels.select(F.col(key_col).cast("long").alias("number"), ((F.col(good_col) == 0) | (F.col(bad_col) == 1)).alias("bad"))
    told = told.where("number IS NOT NULL AND bad IS NOT NULL").groupBy("number").agg(F.max("bad").alias("bad"))
    shown = pages.select(F.col(url_col).alias("url"), number.try_cast("long").alias("number")).where("number IS NOT NULL")
    counts = shown.groupBy("number").agg(F.count(F.lit(1)).alias("n"))
    return join_unique(shown, materialize(told.join(counts, "number"), "outcomes"), "number").select("url", "bad")


def _strength(groups: DataFrame, parent: str | None) -> float:
    """How many outcomes a level's prior weighs, from its groups (n, bad) below each parent: one driver row.

    The rates' spread around the parent's rate beyond what chance gives, pooled over parents with two groups or more.
    """
    seen = groups.where("n > 0")
    n, y = F.col("n").cast("double"), F.col("bad").cast("double")
    sums = [F.count(F.lit(1)).alias("k"), F.sum(n).alias("all"), F.sum(y).alias("hits"), F.sum(n * n).alias("squares"), F.sum(y * y / n).alias("rates")]
    each = (seen.groupBy(parent) if parent else seen.groupBy()).agg(*sums).where("k > 1").withColumn("m", F.expr("hits / all"))
    chance = F.col("m") * (1 - F.col("m"))
    spread, room = F.expr("rates - hits * hits / all") - (F.col("k") - 1) * chance, (F.expr("all - squares / all") - (F.col("k") - 1)) * chance
    spread, room = each.agg(F.sum(spread), F.sum(room)).first()
    if not room or room <= 0:
        return UNKNOWN
    share = min(max(spread / room, 1 / (1 + MOST)), 1 / (1 + LEAST))
    return (1 - share) / share


def reputations(hosts: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(host, n, bad, n_rows, rate, above) of hosts with their outcomes (host, n, bad, n_rows; one row each, n may be 0).

    rate is the posterior's mean, above its share over ``limit``. All levels' tables are written; four rows reach the driver.
    """
    named = materialize(hosts.withColumn("bare", _bare(F.col("host"))).select("host", "n", "bad", "n_rows", suffix_of(F.col("bare")).alias("suffix"), domain_of(F.col("bare")).alias("domain")), "hosts")
    tally = [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("members")]
    domains = materialize(named.groupBy("suffix", "domain").agg(*tally), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(*tally), "suffixes")
    n, bad = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    weights = [_strength(suffixes, None), _strength(domains, "suffix"), _strength(named, "domain")]
    shrunk = lambda w, prior: (F.col("bad") + w * prior) / (F.col("n") + w)
    above = suffixes.select("suffix", shrunk(weights[0], F.lit((bad + 0.5) / (n + 1.0))).alias("prior"), F.col("members").alias("n"))
    # a domain has one suffix, so the domain alone is a key below
    within = join_unique(domains.select("suffix", "domain", F.col("n").alias("n_own"), "bad", "members"), above, "suffix")
    within = within.select("domain", ((F.col("bad") + weights[1] * F.col("prior")) / (F.col("n_own") + weights[1])).alias("prior"), F.col("members").alias("n"))
    found = join_unique(named.withColumnRenamed("n", "n_own"), within, "domain")
    w = weights[2]
    alpha, beta = F.col("bad") + w * F.col("prior"), F.col("n_own") - F.col("bad") + w * (1 - F.col("prior"))
    out = found.select("host", F.col("n_own").alias("n"), "bad", "n_rows", (alpha / (alpha + beta)).alias("rate"), beta_above(alpha, beta, limit).alias("above"))
    out = materialize(out, "reputations")
    for written in (named, domains, suffixes):
        remove(written)
    return out


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[Rule] = RULES,
    limit: float = LIMIT,
    sure: float = SURE,
) -> DataFrame:
    """(id, host, path, rule, verdict, n_labelled, n_bad, bad_rate, above_limit) of every page.

    ``outcomes`` has a url and a truth value, whether the page was bad; rows without either are none, nor are urls without a host. The verdict is that of
    the longest rule that fits (rules are a short list, part of the plan), else block if at least ``sure`` of the host's posterior lies above ``limit``.

    Null urls and those without ``://`` have an empty host and path, and the rate of all outcomes. Null ids and repeated rows stay, each repeated outcome
    counts, other columns are ignored; without outcomes every rate is one half and nothing is blocked. Hosts are
    counted before they are shuffled; the hosts, domains and suffixes that hold most rows are joined by a bounded broadcast.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    told = outcomes.select(host_of(F.col("url").cast("string")).alias("host"), F.col("bad").cast("boolean").cast("long").alias("bad")).where("bad IS NOT NULL AND host <> ''")
    zero = F.lit(0).cast("long")
    both = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_rows")).select("host", zero.alias("n"), zero.alias("bad"), "n_rows")
    both = both.unionByName(told.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")).withColumn("n_rows", zero))
    hosts = reputations(both.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("n_rows").alias("n_rows")), limit)
    known = hosts.where("n_rows > 0").select("host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), F.col("rate").alias("bad_rate"), F.col("above").alias("above_limit"), F.col("n_rows").alias("n"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("above_limit") >= sure, "block").otherwise("allow")
    found = join_unique(rows, known, "host")
    return found.select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_labelled", "n_bad", "bad_rate", "above_limit")
