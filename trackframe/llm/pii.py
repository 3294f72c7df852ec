"""Personal data: fixed patterns, and bootstrapped extraction from their contexts.

The fixed patterns' entities (e-mail and IP addresses, card and phone numbers) are
the seeds. Every occurrence of a seed or of another identifier-like token gives
lexical patterns: the two words before it, the word before with the word after,
and a label (the word before, if it ends in a colon or the like), with digits
made alike. Patterns and instances form a bipartite graph. Spark scores it in
rounds: a pattern's confidence is the smoothed share of its distinct instances
that are believed, an instance's is the chance that one of its patterns is right.
Occurrences that a pattern of high confidence and enough support surrounds are
new spans.

An identifier-like token has at least ``TOKEN_DIGITS`` digits, whatever its length. A
context has the whole words that lie within ``CONTEXT`` characters of an occurrence,
up to the next one of its kind.

Column expressions, joins and aggregations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import apart, as_spans, join_unique, let, materialize, regex_spans, span_list

# The base kinds. The possessive forms and looks at the character before match what
# the plain ones do, [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and the like, without
# trying every start within a long run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

_BYTE = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: An identifier-like token: a run of these characters that has a digit.
_RUN = r"[A-Za-z0-9@._%+/#-]"
TOKEN = rf"(?<!{_RUN})[A-Za-z@._%+/#-]*+[0-9]{_RUN}*+"
TOKEN_DIGITS = 4
CONTEXT = 60
ROUNDS = 3
#: A pattern needs so many distinct believed instances, and such a confidence, to find others.
SUPPORT, CONFIDENCE, BELIEVED = 3, 0.7, 0.5
SMOOTHING = 1.0


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reverse = F.split(F.reverse(digits), "")

    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(reverse, weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The base kinds' matches that hold; failing ones are dropped without another try."""
    digits = lambda x: F.regexp_replace(x["match"], "[^0-9]", "")
    card = lambda x: F.char_length(x["match"]).between(14, 37) & let(digits(x), lambda d: F.char_length(d).between(14, 19) & luhn(d))
    return {
        "email": regex_spans(text, EMAIL, context=CONTEXT),
        "ip": F.filter(regex_spans(text, IP, context=CONTEXT), lambda x: F.rlike(x["match"], F.lit(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z"))),
        "card": F.filter(regex_spans(text, CARD, context=CONTEXT), card),
        "phone": F.filter(regex_spans(text, PHONE, context=CONTEXT), lambda x: F.char_length(digits(x)).between(10, 15)),
    }


def patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of a context, as hashes."""
    alike = lambda x: F.lower(F.regexp_replace(x, "[0-9]", "0"))
    words = lambda x: F.filter(F.split(alike(x), r"\s+"), lambda w: w != "")

    def of(v: Column) -> Column:
        last = F.element_at(v["left"], -1)
        two = F.when(F.size(v["left"]) > 1, F.xxhash64(F.lit("two"), F.element_at(v["left"], F.greatest(F.size(v["left"]) - 1, F.lit(1))), last))
        around = F.when((F.size(v["left"]) > 0) & (F.size(v["right"]) > 0), F.xxhash64(F.lit("around"), last, F.element_at(v["right"], 1)))
        label = F.when(F.rlike(last, F.lit(r"\p{L}.*[:=#]\z")), F.xxhash64(F.lit("label"), last))
        return F.filter(F.array(two, around, label), lambda h: h.isNotNull())

    # element_at must not see an empty array
    padded = lambda a: F.when(F.size(a) > 0, a)
    return F.coalesce(let(F.struct(padded(words(before)).alias("left"), padded(words(after)).alias("right")), of), F.array().cast("array<bigint>"))


def occurrences(base: Column, tokens: Column) -> Column:
    """Seeds, and the identifier-like tokens that overlap none, with their patterns: array of (start, end, seed, instance, patterns)."""
    row = lambda x, seed: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.lit(seed).alias("seed"), F.xxhash64(x["match"]).alias("instance"), patterns(x["before"], x["after"]).alias("patterns")
    )

    def trimmed(x: Column) -> Column:
        match = F.regexp_replace(x["match"], r"[._%+/#-]+\z", "")
        return let(match, lambda t: F.struct(x["start"].alias("start"), (x["start"] + F.char_length(t)).alias("end"), t.alias("match"), x["before"].alias("before"), x["after"].alias("after")))

    def shaped(x: Column) -> Column:
        return F.char_length(F.regexp_replace(x["match"], "[^0-9]", "")) >= TOKEN_DIGITS

    others = let(F.transform(F.filter(tokens, shaped), trimmed), lambda found: apart(base, found))
    return F.concat(F.transform(base, lambda x: row(x, True)), F.transform(others, lambda x: row(x, False)))


def confidences(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence, support, n) of distinct edges (pattern, instance, seed) after ``rounds``.

    Seeds are believed fully and always, other instances not at all at first.
    """
    # of every pattern its edges and seeds, of every other instance its edges: the same in all rounds
    fixed = materialize(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_if("seed").alias("seeds")), "pattern-edges")
    others = edges.where("not seed")
    sizes = materialize(others.groupBy("instance").agg(F.count(F.lit(1)).alias("n")), "instance-edges")
    scored = fixed.withColumn("sum", F.col("seeds").cast("double")).withColumn("support", F.col("seeds"))
    for left in range(rounds, 0, -1):
        scored = scored.select("pattern", (F.col("sum") / (F.col("n") + SMOOTHING)).alias("confidence"), "support", "n")
        scored = materialize(scored.where(F.col("support") >= SUPPORT), "patterns")
        if left > 1:
            doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
            belief = join_unique(others, scored, "pattern").groupBy("instance").agg((1 - doubt).alias("belief"))
            # an instance of many patterns goes to their tasks by a bounded broadcast
            told = join_unique(others, belief.join(sizes, "instance"), "instance")
            more = told.groupBy("pattern").agg(F.sum("belief").alias("more"), F.count_if(F.col("belief") >= BELIEVED).alias("believed"))
            added = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0)))
            scored = fixed.join(more, "pattern", "left").select("pattern", "n", added("seeds", "more").cast("double").alias("sum"), added("seeds", "believed").alias("support"))
    return scored


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, found) of every row of ``docs``: arrays of (start, rank, kind, end).

    ``found`` has the spans (kind ``context``) that confident patterns add; none
    overlaps a base span. A null text is empty. Null ids, repeated rows and
    other columns do no harm; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.select(
        F.col(id_col).alias("id"),
        *(found.alias(kind) for kind, found in base_spans(text).items()),
        regex_spans(text, TOKEN, context=CONTEXT).alias("tokens"),
    )
    rows = raw.select(
        "id",
        F.concat(*(as_spans(F.col(kind), rank, kind) for rank, kind in enumerate(KINDS))).alias("base"),
        occurrences(F.concat(*KINDS), F.col("tokens")).alias("seen"),
    )
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "personal")
    seen = rows.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    edges = seen.select(F.explode("patterns").alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    good = confidences(materialize(edges, "edges")).where(F.col("confidence") >= CONFIDENCE).select("pattern", "n")
    new = join_unique(seen.where("not seed").select("row", "start", "end", F.explode("patterns").alias("pattern")), good, "pattern")
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), F.lit("context").alias("kind"), "end")
    new = new.groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("found"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return rows.join(new, "row", "left").select("id", "base", F.coalesce("found", none).alias("found"))


def digests(scanned: DataFrame) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context, n_spans) of what ``scan`` returns."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "id",
        *map(count, KINDS),
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.concat("base", "found")).alias("spans"),
        F.size("found").cast("long").alias("n_context"),
        (F.size("base") + F.size("found")).cast("long").alias("n_spans"),
    )
