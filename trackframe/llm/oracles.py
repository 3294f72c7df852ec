"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

import re

from trackframe.llm import licenses, reputation, secrets, warc


#: After a comment mark, which a line may lack.
MAYBE = "?[ \\t]*"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _warc_sql(date: str) -> str:
    crlf = "chr(13) || chr(10)"
    uuid = lambda h: f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'"

    def unescape(text: str) -> str:
        for name, char in warc.NAMED.items():
            text = f"replace({text}, '&{name};', {_quote(char)})"
        return f"replace({text}, '&amp;', '&')"

    text = f"regexp_replace(html, {_quote(warc.NO_TEXT)}, '', 'g')"
    text = f"regexp_replace(regexp_replace({text}, {_quote(warc.BLOCK)}, chr(10), 'g'), {_quote(warc.TAG)}, '', 'g')"
    text = f"regexp_replace({unescape(text)}, {_quote(warc.BLANKS)}, ' ', 'g')"
    text = rf"trim(regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
    one_line = lambda x: rf"trim(regexp_replace({unescape(x)}, '\s+', ' ', 'g'))"
    return f"""
WITH pages_ AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
headed AS (SELECT *, 'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(html) AS head FROM pages_),
named AS (SELECT *, md5(concat_ws(' ', 'response', page_id::VARCHAR, url, sha256(html))) AS h FROM headed),
source AS (SELECT *, {uuid("h")} AS refers_to, 'sha256:' || sha256(html) AS source_payload_digest FROM named),
bodies AS (
  SELECT page_id, url, refers_to, source_payload_digest, 'conversion' AS record_type, 'metadata' AS other, 'text/plain; charset=utf-8' AS content_type, {text} AS body FROM source
  UNION ALL
  SELECT page_id, url, refers_to, source_payload_digest, 'metadata', 'conversion', 'application/warc-fields',
    array_to_string(list_concat(['source-record-id: ' || refers_to, 'source-payload-digest: ' || source_payload_digest,
      'source-block-digest: sha256:' || sha256(head || {crlf} || {crlf} || html),
      'title: ' || {one_line(f"regexp_extract(html, {_quote(warc.TITLE)}, 1)")},
      'language: ' || lower(regexp_extract(html, {_quote(warc.LANGUAGE)}, 1))],
      list_transform(string_split(head, {crlf}), lambda x: 'source-http-header: ' || x),
      list_transform(regexp_extract_all(html, {_quote(warc.LINK)}, 1), lambda x: 'outlink: ' || {one_line("x")})), {crlf})
  FROM source),
hashed AS (SELECT *, md5(record_type || ' ' || refers_to) AS a, md5(other || ' ' || refers_to) AS b FROM bodies),
records AS (SELECT page_id, record_type, {uuid("a")} AS record_id, refers_to, {uuid("b")} AS concurrent_to, url AS target_uri, '{date}' AS date, content_type,
  strlen(body)::BIGINT AS content_length, 'sha256:' || sha256(body) AS block_digest, source_payload_digest, body FROM hashed)
SELECT page_id, record_type, record_id, refers_to, concurrent_to, target_uri, date, content_type, content_length, block_digest, source_payload_digest,
  concat_ws({crlf}, 'WARC/1.1', 'WARC-Type: ' || record_type, 'WARC-Record-ID: ' || record_id, 'WARC-Date: ' || date, 'WARC-Target-URI: ' || target_uri,
    'WARC-Refers-To: ' || refers_to, 'WARC-Refers-To-Target-URI: ' || target_uri, 'WARC-Refers-To-Date: ' || date, 'WARC-Concurrent-To: ' || concurrent_to,
    'WARC-Block-Digest: ' || block_digest, 'Content-Type: ' || content_type, 'Content-Length: ' || content_length) AS headers, body
FROM records"""


def _licence_sql() -> str:
    """Every unit of every file is compared: there are no cues here."""
    values = ", ".join(f"({i}, {_quote(name)}, {_quote(text)})" for i, (name, text) in enumerate(licenses.TEMPLATES))
    nots = lambda ws: f"len(list_filter({ws}, lambda w: list_contains({list(licenses.NEGATIONS)}, w)))"
    words = lambda x: f"regexp_extract_all(lower({x}), {_quote(licenses.WORD)})"
    order = f"(licence <> '{licenses.FALLBACK}') DESC, cosine DESC"
    return f"""
WITH files AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR || '.txt') AS path, coalesce(text, '') AS text FROM documents),
total AS (SELECT count(*)::DOUBLE AS n FROM files),
templates AS (SELECT template, licence, {words("text")} AS words, {nots(words("text"))} AS allowed FROM (VALUES {values}) v(template, licence, text)),
vocabulary AS (SELECT DISTINCT unnest(words) AS word FROM templates),
frequency AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({words("text")}) AS word FROM files) GROUP BY word),
idf AS (SELECT word, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM vocabulary LEFT JOIN frequency USING (word), total),
lines AS (SELECT doc_id, path, regexp_split_to_array(text, '\r?\n') AS lines FROM files),
bare AS (SELECT doc_id, path, list_transform(lines, lambda x: regexp_replace(regexp_replace(x, {_quote(licenses.COMMENT + MAYBE)}, ''), {_quote(licenses.COMMENT_END)}, '')) AS bare,
  list_position(list_transform(lines, lambda x: NOT regexp_matches(x, {_quote(licenses.COMMENT)}) AND NOT regexp_matches(x, '^[ \t]*$')), true) AS code FROM lines),
joined AS (SELECT doc_id, path, bare, array_to_string(bare, chr(10)) AS joined, array_to_string(CASE WHEN coalesce(code, 0) = 0 THEN bare ELSE bare[1:code - 1] END, ' ') AS header FROM bare),
blocks AS (SELECT *, list_transform(regexp_split_to_array(joined, '\n\n+'), lambda b: replace(b, chr(10), ' ')) AS blocks FROM joined),
parts AS (SELECT doc_id, path, joined, list_concat([joined, header], list_concat(blocks, list_concat(flatten(list_transform(blocks, lambda b: string_split(regexp_replace(b, {_quote(licenses.SENTENCE_END)}, '\1' || chr(10), 'g'), chr(10)))), bare))) AS parts FROM blocks),
rows_ AS (SELECT doc_id, regexp_replace(path, '/?[^/]*$', '') AS directory, regexp_matches(regexp_extract(path, '[^/]*$'), {_quote(licenses.LICENCE_NAME)}) AS named, array_to_string({words("joined")}, ' ') AS whole,
  list_distinct(list_transform(list_filter(list_transform(parts, lambda x: {words("x")}), lambda w: len(w) BETWEEN 1 AND {licenses.LONGEST}), lambda w: array_to_string(w, ' '))) AS units FROM parts),
said AS (SELECT doc_id, unit, unit = whole AS is_whole FROM (SELECT doc_id, whole, unnest(units) AS unit FROM rows_)),
distinct_ AS (SELECT DISTINCT unit, string_split(unit, ' ') AS words FROM said),
denied AS (SELECT unit, {nots("words")} AS nots FROM distinct_),
terms AS (SELECT unit, word, count(*) AS tf FROM (SELECT unit, unnest(words) AS word FROM distinct_) GROUP BY ALL),
weighed AS (SELECT unit, word, tf * coalesce(idf, (SELECT max(idf) FROM idf)) AS w FROM terms LEFT JOIN idf USING (word)),
norms AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY unit),
vectors AS (SELECT template, licence, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS v FROM (SELECT template, licence, word, count(*) AS tf FROM (SELECT template, licence, unnest(words) AS word FROM templates) GROUP BY ALL) JOIN idf USING (word)),
dots AS (SELECT unit, template, licence, sum(w * v) AS dot FROM weighed JOIN vectors USING (word) GROUP BY ALL),
found AS (SELECT unit, licence, cosine FROM (SELECT unit, template, licence, round(dot / norm, 6) AS cosine FROM dots JOIN norms USING (unit) JOIN denied USING (unit) JOIN (SELECT template, allowed FROM templates) USING (template) WHERE nots <= allowed) WHERE cosine >= {licenses.SIMILARITY} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY {order}, template) = 1),
matched AS (SELECT doc_id, licence, cosine, is_whole FROM said JOIN found USING (unit)),
counts AS (SELECT doc_id, count(*) AS n_statements, bool_or(is_whole) AS whole FROM matched GROUP BY doc_id),
own AS (SELECT doc_id, licence, cosine FROM matched QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {order}, licence) = 1),
stated AS (SELECT r.doc_id, directory, named OR coalesce(c.whole, false) AS is_licence, coalesce(n_statements, 0) AS n_statements, licence, cosine FROM rows_ r LEFT JOIN counts c ON r.doc_id = c.doc_id LEFT JOIN own o ON r.doc_id = o.doc_id),
holders AS (SELECT directory AS above, licence AS given, cosine AS given_cosine FROM stated WHERE is_licence AND licence IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY {order}, licence) = 1),
near AS (SELECT d.directory, above, given, given_cosine FROM (SELECT DISTINCT directory FROM stated) d JOIN holders h ON above = directory OR above = '' OR starts_with(directory, above || '/')
  QUALIFY row_number() OVER (PARTITION BY d.directory ORDER BY length(above) DESC) = 1)
SELECT doc_id, coalesce(licence, given) AS licence, CASE WHEN licence IS NOT NULL THEN 'statement' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  coalesce(cosine, given_cosine) AS cosine, CASE WHEN licence IS NULL THEN above END AS licence_directory, n_statements::BIGINT AS n_statements
FROM stated LEFT JOIN near USING (directory)"""


def _secrets_sql() -> str:
    """The battery in plain SQL; RE2 has no lookahead, so an encoding's needed classes are tested one by one."""

    def fits(pattern: str) -> str:
        needed, allowed = re.findall(r"\(\?=\.\*(\[[^\]]+\])\)", pattern), re.search(r"(\[[^\]]+\]\+)\\z", pattern)[1]
        return " AND ".join([f"regexp_full_match(bare, {_quote(allowed)})", *(f"regexp_matches(bare, {_quote(x)})" for x in needed)])

    def spans(kind: str, pattern: str, group: int, good: str) -> str:
        p = _quote(pattern)
        return f"""SELECT doc_id, '{kind}' AS kind, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start, found[i] AS match, parts[i] AS part
        FROM (SELECT doc_id, pieces, found, parts, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, {p}) AS pieces, regexp_extract_all(text, {p}) AS found, regexp_extract_all(text, {p}, {group}) AS parts FROM texts WHERE regexp_matches(text, {p}))) WHERE {good}"""

    kinds = [("assign", secrets.ASSIGN, 2, "length(part) >= 6"), ("access", secrets.ACCESS, 0, "length(match) >= 20"), ("hex", secrets.HEX, 0, "length(match) >= 24")]
    base = " UNION ALL ".join(f"SELECT {rank} AS rank, * FROM ({spans(*k)})" for rank, k in enumerate(kinds))
    names = " ".join(f"WHEN {fits(pattern)} THEN {i}" for i, (_, pattern, *_) in enumerate(secrets.ENCODINGS))
    labels, _, alphabets, excesses, splits, limits = (list(column) for column in zip(*secrets.ENCODINGS, strict=True))
    padded = " OR ".join(f"encoding = '{x}'" for x in secrets.PADDED)
    classes = " + ".join(f"(n >= {n})::INT" for n in secrets.LENGTHS)
    cdf = lambda z: f"(1 / (1 + exp(-1.5976 * {z} - 0.07056 * {z} * {z} * {z})))"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({base}),
runs AS (SELECT *, CASE {names} END AS which FROM (SELECT *, rtrim(match, '=') AS bare FROM ({spans("run", secrets.CANDIDATE, 0, "true")}))),
symbols AS (SELECT *, {labels}[which + 1] AS encoding, length({alphabets}[which + 1])::DOUBLE AS k, {excesses}[which + 1] AS excess, {splits}[which + 1]::DOUBLE AS split, {limits}[which + 1] AS far, length(bare)::DOUBLE AS n, list_transform(string_split(bare, ''), lambda c: strpos({alphabets}[which + 1], c) - 1) AS s FROM runs WHERE which IS NOT NULL),
means AS (SELECT *, list_sum(s)::DOUBLE / n AS mean, list_sum(list_transform(list_distinct(s), lambda x: len(list_filter(s, lambda y: y = x)) ** 2)) * k / n - n AS chi,
  list_sum(list_transform(range(1, len(s)), lambda i: CASE WHEN (s[i] >= split) <> (s[i + 1] >= split) THEN 1.0 ELSE 0.0 END))::DOUBLE / (n - 1) AS rate FROM symbols),
centred AS (SELECT *, list_transform(s, lambda x: x - mean) AS c FROM means),
serial AS (SELECT *, list_sum(list_transform(c, lambda x: x * x)) AS square, list_sum(list_transform(range(1, len(c)), lambda i: c[i] * c[i + 1])) AS lag FROM centred),
shares AS (SELECT *, CASE WHEN square > 0 THEN lag / square ELSE 1 END AS r, k - 1 + n * excess AS m, 2 * (k - 1 + 2 * n * excess) / (9 * (k - 1 + n * excess) ** 2) AS share FROM serial),
scores AS (SELECT *, greatest(-30, least(30, (pow(greatest(chi, 0) / m, 1 / 3) - (1 - share)) / sqrt(share))) AS z1, greatest(-30, least(30, (abs(rate - expected) - far) * sqrt((n - 1) / (expected * (1 - expected))))) AS z2,
  greatest(-30, least(30, (abs(r) - {secrets.CORRELATION}) * sqrt(n))) AS z3 FROM (SELECT *, 2 * (split / k) * (1 - split / k) AS expected FROM shares)),
levels AS (SELECT *, which * {len(secrets.LENGTHS) + 1} + {classes} AS stratum, least(floor(-log10(greatest({cdf("z1")}, {cdf("z2")}, {cdf("z3")}, 1e-30)) * {secrets.PER_DECADE} + 1e-9), {secrets.LEVELS})::INT AS level FROM scores),
counts AS (SELECT stratum, level, sum(count(*)) OVER (PARTITION BY stratum ORDER BY level DESC) AS seen, least(sum(count(*)) OVER (PARTITION BY stratum), 2 * (1 + coalesce(sum(count(*)) FILTER (WHERE level <= {secrets.HALF}) OVER (PARTITION BY stratum), 0))) AS ordinary FROM levels GROUP BY stratum, level),
cut AS (SELECT stratum, min(level) AS least FROM counts WHERE pow(10, -level / {secrets.PER_DECADE}) <= {secrets.FDR} * least(1, seen / ordinary) GROUP BY stratum),
spans AS (SELECT doc_id, rank, kind, start, start + length(match) AS stop FROM base UNION ALL SELECT doc_id, {len(secrets.KINDS)}, 'random_' || encoding, start, start + CASE WHEN ({padded}) AND length(match) % 4 = 0 THEN length(match) ELSE length(bare) END FROM levels JOIN cut USING (stratum) WHERE level >= least),
digests AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secrets.KINDS)}, count(*) FILTER (WHERE rank = {len(secrets.KINDS)}) AS n_random,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(secrets.KINDS)}) AS own, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.KINDS)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_random, 0) AS n_random
FROM texts t LEFT JOIN digests d ON t.doc_id = d.doc_id"""


def _reputation_sql() -> str:
    """The levels and the incomplete beta function in plain SQL, one expression for each distinct host."""
    r, parts = reputation, _quote(reputation._PARTS)
    least, most = 1 / (1 + r.MOST), 1 / (1 + r.LEAST)
    fits = lambda x: f"((host = '{x.host}' OR ends_with(host, '.{x.host}')) AND starts_with(path, '{x.path}'))"
    rules = sorted(r.RULES, key=lambda x: (-len(x.host + x.path), x.verdict == "allow"))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(x)} THEN '{value(x)}'" for x in rules) + " END"
    two = rf"(?:\A|\.)((?:{'|'.join(r.SECOND_LEVEL)})\.[a-z]{{2}})\z"
    suffix = rf"CASE WHEN regexp_matches(bare, '\A[0-9.]*\z|[\[\]]') THEN bare WHEN regexp_matches(bare, '{two}') THEN regexp_extract(bare, '{two}', 1) ELSE string_split(bare, '.')[-1] END"
    domain = "CASE WHEN suffix = bare THEN bare ELSE array_to_string(string_split(bare, '.')[-1 - len(string_split(suffix, '.')):], '.') END"

    def strength(groups: str, parent: str) -> str:
        return f"""(SELECT CASE WHEN coalesce(sum(room), 0) <= 0 THEN {r.UNKNOWN} ELSE (1 - least(greatest(sum(spread) / sum(room), {least!r}), {most!r})) / least(greatest(sum(spread) / sum(room), {least!r}), {most!r}) END
          FROM (SELECT rates - hits * hits / total - (k - 1) * hits / total * (1 - hits / total) AS spread, (total - squares / total - (k - 1)) * hits / total * (1 - hits / total) AS room
            FROM (SELECT count(*) AS k, sum(n)::DOUBLE AS total, sum(bad)::DOUBLE AS hits, sum(n::DOUBLE * n) AS squares, sum(bad::DOUBLE * bad / n) AS rates FROM {groups} WHERE n > 0 GROUP BY {parent}) WHERE k > 1))"""

    e = "(CASE WHEN e.k % 2 = 0 THEN e.k // 2 * (q - e.k // 2) ELSE -(p + e.k // 2) * (p + q + e.k // 2) END * x / ((p + e.k - 1) * (p + e.k)))"
    fraction = f"list_reduce(list_transform(range(2, (61 + 6 * sqrt(p + q))::BIGINT), lambda k: {{'k': k, 'c': 1.0::DOUBLE, 'd': 1.0::DOUBLE, 'h': 1.0::DOUBLE}}), lambda acc, e: {{'k': e.k, 'c': 1 + {e} / acc.c, 'd': 1 / (1 + {e} * acc.d), 'h': acc.h * (1 + {e} / acc.c) / (1 + {e} * acc.d)}}, {{'k': 1::BIGINT, 'c': 1.0::DOUBLE, 'd': 1 / (1 - (p + q) * x / (p + 1)), 'h': 1 / (1 - (p + q) * x / (p + 1))}}).h"
    return rf"""
WITH parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, {parts}, 1), '{r._UPPER}', '{r._LOWER}'), '') AS host, coalesce(regexp_extract(url, {parts}, 2), '') AS path FROM pages),
labelled AS (SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
told AS (SELECT host, bad FROM parts JOIN labelled ON doc_id = TRY_CAST(regexp_extract(path, '\A/[a-z]+/([0-9]+)', 1) AS BIGINT) WHERE host <> ''),
counts AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM told GROUP BY host),
hosts AS (SELECT host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, regexp_replace(regexp_replace(host, '\A.*@', ''), '\.?(?::[0-9]*)?\z', '') AS bare FROM (SELECT DISTINCT host FROM parts) LEFT JOIN counts USING (host)),
suffixed AS (SELECT *, {suffix} AS suffix FROM hosts),
named AS MATERIALIZED (SELECT *, {domain} AS domain FROM suffixed),
domains AS MATERIALIZED (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY suffix, domain),
suffixes AS MATERIALIZED (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
strengths AS MATERIALIZED (SELECT {strength("suffixes", "true")} AS w0, {strength("domains", "suffix")} AS w1, {strength("named", "domain")} AS w2, (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM suffixes) AS m),
top AS (SELECT suffix, (bad + w0 * m) / (n + w0) AS prior, w1, w2 FROM suffixes, strengths),
middle AS (SELECT domain, (bad + w1 * prior) / (n + w1) AS prior, w2 FROM domains JOIN top USING (suffix)),
posteriors AS (SELECT host, n, bad, bad + w2 * prior AS a, n - bad + w2 * (1 - prior) AS b FROM named JOIN middle USING (domain)),
sides AS (SELECT *, {r.LIMIT} >= (a + 1) / (a + b + 2) AS flipped FROM posteriors),
given AS (SELECT *, CASE WHEN flipped THEN b ELSE a END AS p, CASE WHEN flipped THEN a ELSE b END AS q, CASE WHEN flipped THEN 1 - {r.LIMIT} ELSE {r.LIMIT} END::DOUBLE AS x FROM sides),
tails AS (SELECT *, exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(x) + q * ln(1 - x)) / p * {fraction} AS tail FROM given),
judged AS MATERIALIZED (SELECT host, n, bad, a / (a + b) AS rate, CASE WHEN flipped THEN tail ELSE 1 - tail END AS above FROM tails)
SELECT page_id, host, path, {case(lambda x: x.host + x.path)} AS rule, coalesce({case(lambda x: x.verdict)}, CASE WHEN above >= {r.SURE} THEN 'block' ELSE 'allow' END) AS verdict,
  n::BIGINT AS n_labelled, bad::BIGINT AS n_bad, round(rate, 6) AS bad_rate, round(above, 6) AS above_limit
FROM parts JOIN judged USING (host)"""


#: ``pages`` has no fetch date.
WARC_DATE = "2025-01-01T00:00:00Z"

ORACLES: dict[str, str] = {"op1_secret_scans": _secrets_sql(), "op5_license_scans": _licence_sql(), "op8_warc_derivatives": _warc_sql(WARC_DATE), "op11_url_filters": _reputation_sql()}
