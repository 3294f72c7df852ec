"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control.

The battery looks at every long run of encoding characters. Its encoding is
inferred (the smallest alphabet of which it has every class of characters), and
three statistics measure how far its symbols are from independent uniform ones:
chi-squared over the alphabet, the rate at which symbols cross the alphabet's
split (runs), and the lag-1 serial correlation. The split is the alphabet's middle, or, for letters only, that
between vowels and others, which words cross far more often than random letters. Each is tested against "at least
as far from random as ordinary identifiers are" (``ENCODINGS`` and ``CORRELATION``), so that a small p-value speaks for a secret; the p-value of the battery is
the largest of the three. The distance that a test can exclude depends on the length,
so false discoveries are controlled by length: within each stratum of an encoding and a
length class (``LENGTHS``) the adaptive Benjamini-Hochberg rule at level ``FDR`` holds,
which estimates from the p-values above 0.5 how many runs are ordinary. No run with
a p-value above ``FDR`` is taken. The rule needs only how many runs of a stratum have
each p-value, rounded up to one of ``LEVELS`` values.

Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import as_spans, blocks, let, materialize, part, prefixes, quoted, regex_spans, span_list

# The base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")

#: Runs that are tested; the padding of base64 is no symbol.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_VOWELS = "aeiou"
#: Letters with the vowels first, which words alternate with the others.
_SPOKEN = _VOWELS + "".join(c for c in _LOWER if c not in _VOWELS)
_BOTH = _VOWELS + _VOWELS.upper() + _SPOKEN[5:] + _SPOKEN[5:].upper()
#: name, characters and needed classes, alphabet; what counts as ordinary: the excess of chi-squared for each symbol, the place that
#: splits the alphabet for the runs test, and the distance of the crossing rate from that of random symbols. The first that fits is inferred.
ENCODINGS = (
    ("digits", r"\A[0-9]+\z", _DIGITS, 0.8, 5, 0.42),
    ("hex", r"\A(?=.*[0-9])(?=.*[a-f])[0-9a-f]+\z", _DIGITS + "abcdef", 1.4, 8, 0.42),
    ("hex_upper", r"\A(?=.*[0-9])(?=.*[A-F])[0-9A-F]+\z", _DIGITS + "ABCDEF", 1.4, 8, 0.42),
    ("lower", r"\A[a-z]+\z", _SPOKEN, 0.9, 5, 0.4),
    ("upper", r"\A[A-Z]+\z", _SPOKEN.upper(), 0.9, 5, 0.4),
    ("base32", r"\A(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+\z", _UPPER + "234567", 1.4, 16, 0.42),
    ("base36", r"\A(?=.*[0-9])(?=.*[a-z])[a-z0-9]+\z", _DIGITS + _LOWER, 1.4, 18, 0.42),
    ("base36_upper", r"\A(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+\z", _DIGITS + _UPPER, 1.4, 18, 0.42),
    ("letters", r"\A(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+\z", _BOTH, 2.2, 10, 0.4),
    ("base62", r"\A(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+\z", _UPPER + _LOWER + _DIGITS, 1.8, 31, 0.42),
    ("base64", r"\A(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+\z", _UPPER + _LOWER + _DIGITS + "+/", 1.8, 32, 0.42),
    ("base64url", r"\A(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+\z", _UPPER + _LOWER + _DIGITS + "-_", 1.5, 32, 0.42),
)
#: Those that may end with padding, which counts if it fills up a group of four.
PADDED = ("base64", "base64url")
#: Size of the correlation that counts as ordinary.
CORRELATION = 0.75
#: Where a new length class begins.
LENGTHS = (24, 32, 48, 96)
FDR = 0.1
#: p-values count as 10 ** (-level / 50).
LEVELS, PER_DECADE = 1000, 50
#: The last level whose p-value is above 0.5.
HALF = 15


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function to within 0.00015, by a logistic curve."""
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def chi_squared(symbols: Column, size: Column) -> Column:
    """Of the counts of an array of symbol numbers against a uniform alphabet of ``size``."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"))

    def step(a: Column, x: Column) -> Column:
        again = F.struct(a["last"].alias("last"), (a["run"] + 1).alias("run"), a["total"].alias("total"))
        new = F.struct(x.alias("last"), F.lit(1).cast("long").alias("run"), (a["total"] + a["run"] * a["run"]).alias("total"))
        return F.when(a["last"] == x, again).otherwise(new)

    squares = F.aggregate(F.array_sort(symbols), start, step, lambda a: a["total"] + a["run"] * a["run"])
    return squares * size / F.size(symbols) - F.size(symbols)


def crossing_rate(symbols: Column, split: Column) -> Column:
    """The share of neighbours that lie on different sides of a place of the alphabet."""
    side = F.transform(symbols, lambda x: x >= split)
    n = F.size(symbols) - 1
    pairs = let(side, lambda s: F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n), lambda a, b: F.when(a != b, 1.0).otherwise(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / n


def serial_correlation(symbols: Column) -> Column:
    """The lag-1 autocorrelation; 1 where all symbols are equal."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    n = F.size(symbols)
    centred = let(total(symbols) / n, lambda m: F.transform(symbols, lambda x: x - m))

    def ratio(c: Column) -> Column:
        square = total(F.transform(c, lambda x: x * x))
        lag = total(F.zip_with(F.slice(c, F.lit(1), n - 1), F.slice(c, F.lit(2), n - 1), lambda a, b: a * b))
        return F.when(square > 0, lag / square).otherwise(F.lit(1.0))

    return let(centred, ratio)


def battery_p(symbols: Column, size: Column, excess: Column, split: Column, limit: Column) -> Column:
    """The largest p-value of the three tests that the symbols are closer to random than what counts as ordinary."""
    n = F.size(symbols)
    mean, spread = size - 1 + n * excess, 2 * (size - 1 + 2 * n * excess)
    share = spread / (9 * mean * mean)
    cube_root = F.pow(F.greatest(chi_squared(symbols, size), F.lit(0.0)) / mean, F.lit(1 / 3))
    p_chi = normal_cdf((cube_root - (1 - share)) / F.sqrt(share))
    expected = 2 * (split / size) * (1 - split / size)
    p_runs = normal_cdf((F.abs(crossing_rate(symbols, split) - expected) - limit) * F.sqrt((n - 1) / (expected * (1 - expected))))
    p_serial = normal_cdf((F.abs(serial_correlation(symbols)) - CORRELATION) * F.sqrt(n))
    return F.greatest(p_chi, p_runs, p_serial)


def candidates(text: Column) -> Column:
    """Runs whose encoding is inferred: array of (start, end, encoding, stratum, level)."""

    def encoded(x: Column) -> Column:
        bare = F.rtrim(x["match"], F.lit("="))
        which = F.lit(None).cast("int")
        for i, (_, pattern, *_) in reversed(list(enumerate(ENCODINGS))):
            which = F.when(F.rlike(bare, F.lit(pattern)), i).otherwise(which)
        return F.struct(x["start"].alias("start"), bare.alias("bare"), F.char_length(x["match"]).alias("whole"), which.alias("which"))

    names, _, alphabets, excesses, splits, limits = (F.array(*map(F.lit, column)) for column in zip(*ENCODINGS, strict=True))

    def tested(x: Column) -> Column:
        of = lambda values: F.element_at(values, x["which"] + 1)
        symbols = let(of(alphabets), lambda a: F.transform(F.split(x["bare"], ""), lambda c: F.instr(a, c) - 1))
        p = let(symbols, lambda s: battery_p(s, F.char_length(of(alphabets)), of(excesses), of(splits), of(limits)))
        level = F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * PER_DECADE + 1e-9), F.lit(LEVELS)).cast("int")
        size = F.char_length(x["bare"])
        length_class = F.lit(0)
        for n in LENGTHS:
            length_class = length_class + (size >= n).cast("int")
        stratum = x["which"] * (len(LENGTHS) + 1) + length_class
        length = F.when(of(names).isin(*PADDED) & (x["whole"] % 4 == 0), x["whole"]).otherwise(size)
        return F.struct(x["start"].alias("start"), (x["start"] + length).alias("end"), of(names).alias("encoding"), stratum.alias("stratum"), level.alias("level"))

    found = F.transform(regex_spans(text, CANDIDATE), encoded)
    return F.transform(F.filter(found, lambda x: x["which"].isNotNull()), tested)


def threshold(counts: dict[int, int], fdr: float = FDR) -> int:
    """The lowest level that the adaptive Benjamini-Hochberg rule accepts, given how many runs have each level; above all levels if none."""
    total, seen, best = sum(counts.values()), 0, LEVELS + 1
    ordinary = min(total, 2 * (1 + sum(n for level, n in counts.items() if level <= HALF)))
    for level in sorted(counts, reverse=True):
        seen += counts[level]
        if 10 ** (-level / PER_DECADE) <= fdr * min(1.0, seen / ordinary):
            best = level
    return best


def base_spans(text: Column) -> dict[str, Column]:
    """The base kinds' spans; failing matches are dropped without another try."""
    return {
        "assign": F.filter(regex_spans(text, ASSIGN, 2), lambda x: F.char_length(x["part"]) >= 6),
        "access": F.filter(regex_spans(text, ACCESS), lambda x: F.char_length(x["match"]) >= 20),
        # a maximal run of at least 24 is what the pattern finds and the rule keeps
        "hex": regex_spans(text, HEX[:-1] + "{24,}"),
    }


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), fdr: float = FDR) -> DataFrame:
    """(id, base, found[, kept]) of every row of ``docs``; ``kept`` is a struct of the columns ``keep``, whatever their names.

    ``base`` and ``found`` are arrays of (start, rank, kind, end): the base
    kinds' spans and those of the battery, whose kind names the encoding. A null
    text is empty. Null ids, repeated rows and other columns do no harm; an
    empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*(as_spans(found, rank, kind) for rank, (kind, found) in enumerate(base_spans(text).items())))
    kept = F.struct(*map(quoted, keep)) if keep else F.lit(None)
    rows = docs.select(F.col(id_col).alias("id"), kept.alias("kept"), base.alias("base"), candidates(text).alias("runs"))
    rows = materialize(rows, "secrets")
    levels = rows.select(F.explode("runs").alias("r")).groupBy("r.stratum", "r.level").agg(F.count("*").alias("n"))
    strata: list[dict[int, int]] = [{} for _ in range(len(ENCODINGS) * (len(LENGTHS) + 1))]
    for r in levels.collect():  # at most LEVELS + 1 rows of a stratum
        strata[r["stratum"]][r["level"]] = r["n"]
    least = F.array(*(F.lit(threshold(own, fdr)) for own in strata))
    good = F.filter("runs", lambda x: x["level"] >= F.element_at(least, x["stratum"] + 1))
    found = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.concat(F.lit("random_"), x["encoding"]).alias("kind"), x["end"].alias("end")))
    return rows.select("id", *(["kept"] if keep else []), "base", found.alias("found"))


def digests(scanned: DataFrame) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of what ``scan`` returns."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "id",
        *map(count, KINDS),
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.concat("base", "found")).alias("spans"),
        F.size("found").cast("long").alias("n_random"),
    )


def masked(text: Column, spans: Column, mask: str = "<SECRET>") -> Column:
    """``text`` with the union of ``spans`` replaced; overlapping spans give one mask."""

    def joined(v: Column) -> Column:
        n = F.size(v["spans"])
        reached = prefixes(F.transform(v["spans"], lambda x: x["end"]), lambda a, x: F.greatest(a, x))

        def cut(at: Column) -> Column:
            gaps = F.zip_with(v["spans"], F.slice(at, F.lit(1), n), lambda x, a: F.when(x["start"] >= a, part(v["blocks"], a, x["start"])))
            return F.array_join(F.concat(F.filter(gaps, lambda g: g.isNotNull()), F.array(part(v["blocks"], F.element_at(at, -1), v["size"]))), mask)

        return let(reached, cut)

    whole = F.struct(F.array_sort(spans).alias("spans"), blocks(text).alias("blocks"), F.char_length(text).cast("long").alias("size"))
    return F.when(F.size(spans) > 0, let(whole, joined)).otherwise(text)
