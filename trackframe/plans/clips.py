"""Queries over transcripts, hypotheses, boxes, images and files, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackframe.functions import geometry, tensor, text
from trackframe.operators import nbest, offline, pixels, tracking
from trackframe.params import Preprocessing
from trackframe.plans.tables import KEYPOINTS_SQL, folder_of, keypoints, table
from trackframe.sources import files
from trackframe.streaming import scorers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- transcripts: turn n is the reference, turn n + 1 the hypothesis; SQL has no NFKC, so it holds for texts that NFKC leaves as they are

_NORMAL = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s\p{{Z}}'']', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"
_PAIRS = f"""pairs AS (SELECT a.conv_id, a.turn, a.role, {_NORMAL.format("a.text")} AS ref, {_NORMAL.format("coalesce(b.text, '')")} AS hyp
  FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.normalise(F.col("text")).alias("ref"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("hyp"))
    return turns.join(after, ["conv_id", "turn"], "left").withColumn("hyp", F.coalesce("hyp", F.lit("")))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, ref, hyp FROM pairs")
def reference_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", "ref", "hyp")


@query(f"SELECT doc_id, {_NORMAL.format('text')} AS normal, len(list_filter(string_split({_NORMAL.format('text')}, ' '), lambda w: w <> '')) AS n_words FROM documents")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text")).alias("normal"))
    return rows.withColumn("n_words", F.size(text.words(F.col("normal"))).cast("long"))


#: Edit distances by a recursive walk over the reference's words; a row's running minimum gives the insertions.
_DISTANCES = f"""{_PAIRS}, w AS (SELECT conv_id, turn, role, list_filter(string_split(ref, ' '), lambda x: x <> '') AS a, list_filter(string_split(hyp, ' '), lambda x: x <> '') AS b FROM pairs),
d AS (SELECT conv_id, turn, 0 AS i, range(0, len(b) + 1) AS r FROM w
  UNION ALL
  SELECT conv_id, turn, i + 1, list_transform(range(1, len(c) + 1), lambda j: j + list_min(list_transform(range(1, j + 1), lambda k: c[k] - k)))
  FROM (SELECT d.conv_id, d.turn, d.i, list_transform(range(0, len(b) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(r[j + 1] + 1, r[j] + CASE WHEN b[j] = a[i + 1] THEN 0 ELSE 1 END) END) AS c
    FROM d JOIN w ON d.conv_id = w.conv_id AND d.turn = w.turn WHERE i < len(a))),
e AS (SELECT w.conv_id, w.turn, w.role, r[-1]::BIGINT AS errors, len(a)::BIGINT AS total FROM d JOIN w ON d.conv_id = w.conv_id AND d.turn = w.turn WHERE i = len(a))"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).withColumn("e", text.word_errors(F.col("ref"), F.col("hyp")))
    return rows.select("conv_id", "turn", "role", "e.errors", "e.total")


@query(f"WITH RECURSIVE {_DISTANCES} SELECT conv_id, turn, errors, total, round(CASE WHEN total = 0 THEN 0 ELSE errors / total END, 6) AS rate FROM e")
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _errors(spark, sf_dir)
    return rows.select("conv_id", "turn", "errors", "total", F.round(text.rate(F.col("errors"), F.col("total")), 6).alias("rate"))


@query(f"WITH RECURSIVE {_DISTANCES} SELECT role, sum(errors)::BIGINT AS errors, sum(total)::BIGINT AS total, round(sum(errors) / sum(total), 6) AS rate FROM e GROUP BY role")
def corpus_word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of errors over sums of words for each source (here the role)."""
    sums = _errors(spark, sf_dir).groupBy("role").agg(F.sum("errors").alias("errors"), F.sum("total").alias("total"))
    return sums.withColumn("rate", F.round(text.rate(F.col("errors"), F.col("total")), 6))


@query(
    f"""WITH RECURSIVE {_DISTANCES}, s AS (SELECT sum(errors) FILTER (WHERE role = 'user') / sum(total) FILTER (WHERE role = 'user') AS a, sum(errors) FILTER (WHERE role = 'assistant') / sum(total) FILTER (WHERE role = 'assistant') AS b FROM e)
SELECT round(100 * a, 6) AS user_percent, round(100 * b, 6) AS assistant_percent, round(100 * (b - a), 6) AS gap FROM s"""
)
def source_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources' corpus rates side by side, and their gap in points."""
    sums = _errors(spark, sf_dir).groupBy().pivot("role", ["user", "assistant"]).agg(F.sum("errors").alias("e"), F.sum("total").alias("t"))
    a, b = (100 * text.rate(F.col(f"{k}_e"), F.col(f"{k}_t")) for k in ("user", "assistant"))
    return sums.select(F.round(a, 6).alias("user_percent"), F.round(b, 6).alias("assistant_percent"), F.round(b - a, 6).alias("gap"))


@query()
def character_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DuckDB's distance counts bytes, so this has no SQL; ``tests/test_operators.py`` holds it against brute force."""
    rows = pairs(spark, sf_dir).withColumn("e", text.character_errors(F.col("ref"), F.col("hyp")))
    return rows.select("conv_id", "turn", "e.errors", "e.total", text.rate_text(F.col("e.errors"), F.col("e.total")).alias("shown"))


@query("SELECT conv_id, turn, upper(lower(text)[1:1]) || lower(text)[2:] AS sentence FROM conversations")
def sentence_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.sentence_case(F.col("text")).alias("sentence"))


_VOCAB = ["<blank>", "<unk>", "▁the", "ing", "▁a", "er", "<space>", "on", "▁re", "<eos>"]


@query(
    f"""WITH i AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w, k: (length(w) * 7 + k) % 11 - 1) AS ids FROM documents),
s AS (SELECT doc_id, ids, CASE WHEN ids[1] = 9 THEN ids[2:] ELSE ids END AS led FROM i),
t AS (SELECT doc_id, ids, led[1:coalesce(list_max(list_transform(range(1, len(led) + 1), lambda k: CASE WHEN led[k] <> 9 THEN k ELSE 0 END)), 0)] AS bare FROM s)
SELECT doc_id, array_to_string(bare, ',') AS bare, trim(replace(replace(replace(replace(array_to_string(list_transform(list_filter(ids, lambda x: x <> -1), lambda x: {_VOCAB}[x + 1]), ''), '<space>', ' '), '▁', ' '), '<eos>', ''), '<blank>', '')) AS transcript FROM t"""
)
def detokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id for each word of a text, by its length and place; the vocabulary's last piece ends a hypothesis."""
    ids = F.transform(F.split("text", " "), lambda w, k: ((F.char_length(w) * 7 + k + 1) % 11 - 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))
    vocabulary = F.array(*map(F.lit, _VOCAB))
    bare = text.strip_special(F.col("ids"), F.lit(len(_VOCAB) - 1))
    return rows.select("doc_id", F.array_join(bare, ",").alias("bare"), text.detokenise(F.col("ids"), vocabulary).alias("transcript"))


_UNITS = [f"{piece}  {i}" for i, piece in enumerate(_VOCAB)] + ["", "  "]


@query(
    f"""WITH u AS (SELECT unnest({_UNITS!r}) AS line), v AS (SELECT regexp_extract(trim(line), '^\\S+') AS piece, regexp_extract(trim(line), '\\S+$')::INT AS id FROM u WHERE trim(line) <> ''),
w AS (SELECT conv_id, turn, k, string_split(text, ' ')[k] AS piece FROM (SELECT *, unnest(range(1, len(string_split(text, ' ')) + 1)) AS k FROM conversations))
SELECT conv_id, turn, string_agg(coalesce(id, 1), ',' ORDER BY k) AS ids FROM w LEFT JOIN v ON w.piece = v.piece GROUP BY ALL"""
)
def piece_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of a turn as a piece: its id by the lines of a units file, that of ``<unk>`` for others."""
    lines = spark.createDataFrame([(x,) for x in _UNITS], "line string").select(text.unit_line(F.col("line")).alias("u")).where("u is not null")
    # a vocabulary is bounded; it becomes one map
    ids = F.create_map(*(F.lit(x) for r in lines.select("u.*").collect() for x in (r.piece, r.token_id)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.piece_ids(F.split("text", " "), ids), ",").alias("ids"))


# --- hypotheses: a document is a hypothesis of the clip that its source names

_HYP = "h AS (SELECT source, doc_id, text, -n_chars / 100 AS score, n_chars // 5 AS tokens FROM documents)"
_CONF = "CASE WHEN tokens <= 0 THEN 0 ELSE least(1, exp(score / tokens)) END"


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    rows = rows.select("source", "doc_id", "text", (-F.col("n_chars") / 100).alias("score"), F.floor(F.col("n_chars") / 5).alias("tokens"))
    return rows.withColumn("confidence", nbest.confidence(F.col("score"), F.col("tokens")))


@query(f"WITH {_HYP} SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank, round({_CONF}, 6) AS confidence FROM h QUALIFY rank <= 3")
def n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = nbest.rank(hypotheses(spark, sf_dir), "source", "score", "doc_id", 3)
    return ranked.select("source", "doc_id", "rank", F.round("confidence", 6).alias("confidence"))


@query(
    f"""WITH {_HYP}, r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank, round_even({_CONF}, 4) AS confidence FROM h QUALIFY rank <= 3)
SELECT source, max(doc_id) FILTER (WHERE rank = 1) AS best, max(confidence) FILTER (WHERE rank = 1) AS confidence, array_to_string(list(doc_id ORDER BY rank) FILTER (WHERE rank > 1), ',') AS alternatives FROM r GROUP BY source"""
)
def best_and_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = nbest.rank(hypotheses(spark, sf_dir).withColumn("key", F.col("doc_id").cast("string")), "source", "score", "doc_id", 3)
    rows = nbest.best_and_rest(ranked, "source", "key")
    return rows.select("source", F.col("text").cast("long").alias("best"), "confidence", F.array_join("alternatives.text", ",").alias("alternatives"))


@query(f"WITH {_HYP}, c AS (SELECT doc_id, {_CONF} AS c FROM h) SELECT doc_id, CASE WHEN c < 0.4 THEN 'weak' WHEN c < 0.6 THEN 'warn' ELSE 'signal' END AS tier, floor(c * 100 + 0.5)::INT AS percent FROM c")
def confidence_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hypotheses(spark, sf_dir)
    return rows.select("doc_id", nbest.tier(F.col("confidence")).alias("tier"), nbest.percent(F.col("confidence")).alias("percent"))


@query(
    f"""WITH {_HYP}, f AS (SELECT source, doc_id, score * 0.9 + (-(doc_id % 17)) * 0.1 AS fused FROM h)
SELECT source, doc_id, round(fused, 6) AS fused FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY fused DESC, doc_id) = 1"""
)
def score_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = nbest.fuse(F.col("score"), -(F.col("doc_id") % 17), F.lit(0.0), F.lit(0.0))
    ranked = nbest.rank(hypotheses(spark, sf_dir).withColumn("fused", fused), "source", "fused", "doc_id", 1)
    return ranked.select("source", "doc_id", F.round("fused", 6).alias("fused"))


_CLIPS = "c AS (SELECT doc_id, n_chars % 40 AS total, least(n_chars % 40, n_chars % 23) AS seen, lang <> 'de' AS ready, n_chars % 7 AS n FROM documents), s AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE seen / total END AS ratio FROM c)"


@query(
    f"""WITH {_CLIPS} SELECT doc_id, ratio >= 0.3 AS mouth_detected, CASE
  WHEN ratio < 0.3 THEN 'The mouth was only visible in ' || round_even(ratio * 100, 0)::INT || '% of frames, which is too little to read. Face the camera and keep your mouth in view.'
  WHEN total < 8 THEN 'Clip is ' || total || ' frames; at least 8 are needed.' WHEN NOT ready THEN 'The speech model is not loaded.'
  WHEN n = 0 THEN 'The model produced no transcript for this clip.' END AS error FROM s"""
)
def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a clip; its length gives frame counts."""
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select("doc_id", (n % 40).alias("total"), F.least(n % 40, n % 23).alias("seen"), (F.col("lang") != "de").alias("ready"), (n % 7).alias("n"))
    ratio = text.rate(F.col("seen"), F.col("total"))
    return rows.select("doc_id", nbest.outcome(ratio, F.col("total"), F.col("ready"), F.col("n")).alias("o")).select("doc_id", "o.*")


@query(
    """SELECT user_id AS clip_id, count(*) AS total_frames, least(count(*) FILTER (WHERE event_type <> 'error'), count(*) FILTER (WHERE value > 5)) AS detected_frames,
round(detected_frames / total_frames, 6) AS detection_ratio, round(total_frames / 25, 6) AS duration_s FROM events GROUP BY 1"""
)
def clip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumnRenamed("user_id", "clip_id")
    found = nbest.clip_summary(rows, "clip_id", F.col("event_type") != "error", F.col("value") > 5, F.lit(25.0))
    return found.withColumns({k: F.round(k, 6) for k in ("detection_ratio", "duration_s")})


@query(
    f"""WITH {_HYP}, j AS (SELECT doc_id, lang, source, n_chars FROM documents)
SELECT doc_id, '{{"text":"' || lang || '","frames_processed":' || (n_chars % 40) || CASE WHEN n_chars % 3 = 0 THEN ',"error":"too short"' ELSE '' END || CASE WHEN n_chars % 2 = 0 THEN ',"diagnostics":{{"lang":"' || lang || '"' || CASE WHEN n_chars % 4 = 0 THEN ',"source":"' || source || '"' ELSE '' END || '}}' ELSE '' END || '}}' AS json FROM j"""
)
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents")
    none = F.create_map().cast("map<string,string>")
    # the second map's language is the one that counts
    more = F.when(n % 2 == 0, nbest.merged(F.create_map(F.lit("lang"), F.lit("??")), F.create_map(F.lit("lang"), F.col("lang")), F.when(n % 4 == 0, F.create_map(F.lit("source"), F.col("source"))).otherwise(none))).otherwise(none)
    error = F.when(n % 3 == 0, "too short").otherwise("")
    return rows.select("doc_id", nbest.result_json(F.col("lang"), F.lit(None).cast("double"), n % 40, error, more).alias("json"))


# --- boxes: an order is a frame of its customer's stream, its lines are candidates

_BOXES = """cand AS (SELECT o_custkey AS stream_id, o_orderkey AS frame, l_linenumber AS cand, (l_partkey % 50)::INT AS x, (l_suppkey % 40)::INT AS y, (20 + l_quantity)::INT AS width, (20 + 3 * l_linenumber)::INT AS height
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey QUALIFY row_number() OVER (PARTITION BY o_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    once = Window.partitionBy("o_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity")
    lines = lines.withColumn("_r", F.row_number().over(once)).where("_r = 1")
    box = geometry.box(F.col("l_partkey") % 50, F.col("l_suppkey") % 40, 20 + F.col("l_quantity"), 20 + 3 * F.col("l_linenumber"))
    return lines.select(F.col("o_custkey").alias("stream_id"), F.col("o_orderkey").alias("frame"), F.col("l_linenumber").alias("cand"), box.alias("box"))


def _iou(a: str, b: str) -> str:
    side = lambda k, n: f"greatest(0, least({a}{k} + {a}{n}, {b}{k} + {b}{n}) - greatest({a}{k}, {b}{k}))"
    both = f"({side('x', 'width')} * {side('y', 'height')})"
    return f"(CASE WHEN {both} > 0 THEN {both} / ({a}width * {a}height + {b}width * {b}height - {both}) ELSE 0 END)"


@query(f"WITH {_BOXES} SELECT a.frame, a.cand, round({_iou('a.', 'b.')}, 12) AS iou, a.x + a.width / 2 AS centre_x, a.y + a.height / 2 AS centre_y FROM cand a JOIN cand b ON a.frame = b.frame AND b.cand = a.cand + 1")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    after = rows.select("frame", (F.col("cand") - 1).alias("cand"), F.col("box").alias("other"))
    found = rows.join(after, ["frame", "cand"])
    centre = geometry.centre(F.col("box"))
    return found.select("frame", "cand", F.round(geometry.iou(F.col("box"), F.col("other")), 12).alias("iou"), centre["x"].alias("centre_x"), centre["y"].alias("centre_y"))


@query(
    f"""WITH RECURSIVE {_BOXES}, n AS (SELECT *, dense_rank() OVER (PARTITION BY stream_id ORDER BY frame) AS i, count(*) OVER (PARTITION BY frame) AS n FROM cand),
r AS (SELECT stream_id, i, frame, cand, x, y, width, height FROM n WHERE i = 1 QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY width * height DESC, cand) = 1
  UNION ALL
  SELECT stream_id, i, frame, cand, x, y, width, height FROM (SELECT n.*, {_iou('r.', 'n.')} AS u, max({_iou('r.', 'n.')}) OVER (PARTITION BY n.stream_id) AS m FROM r JOIN n ON n.stream_id = r.stream_id AND n.i = r.i + 1)
  QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY CASE WHEN n > 1 AND m >= 0.2 THEN u ELSE width * height END DESC, cand) = 1)
SELECT stream_id, frame, cand, x, y FROM r"""
)
def subject_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, path = candidates(spark, sf_dir), folder_of(spark, "candidates")
    made.write.parquet(path)  # once, for all walks
    tracked = tracking.track(spark.read.schema(made.schema).parquet(path), "stream_id", "frame", "cand", "box")
    return tracked.select("stream_id", "frame", "cand", "box.x", "box.y")


@query(f"WITH {_BOXES} SELECT frame, cand, x FROM (SELECT *, cand % 2 AS d, min(cand % 2) OVER (PARTITION BY frame) AS m FROM cand) WHERE d = m")
def detector_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even candidates come from the first detector, odd ones from the second."""
    rows = candidates(spark, sf_dir).withColumn("detector", F.col("cand") % 2)
    return tracking.preferred(rows, ["frame"], "detector").select("frame", "cand", "box.x")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_discount * 640, 0)::INT AS x, round_even(l_tax * 480, 0)::INT AS y, round_even(l_quantity / 100 * 640, 0)::INT AS width, round_even((l_discount - 0.02) * 480, 0)::INT AS height
FROM lineitem WHERE round_even(l_quantity / 100 * 640, 0) > 0 AND round_even((l_discount - 0.02) * 480, 0) > 0"""
)
def pixel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount, tax and quantity stand for relative coordinates; boxes without area are dropped."""
    rows = table(spark, sf_dir, "lineitem")
    box = geometry.pixel_box(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100, F.col("l_discount") - 0.02, F.lit(640), F.lit(480))
    return rows.withColumn("b", box).where("b is not null").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "b.*")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(8, round_even((20 + l_quantity) * 0.45, 0))::INT AS w, greatest(8, round_even((20 + 3 * l_linenumber) * 0.28, 0))::INT AS h,
round_even(l_partkey % 50 - w / 2, 0)::INT AS x, round_even(l_suppkey % 40 - h / 2, 0)::INT AS y FROM lineitem"""
)
def mouth_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    face = geometry.box(F.lit(0), F.lit(0), 20 + F.col("l_quantity"), 20 + 3 * F.col("l_linenumber"))
    point = F.struct((F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 40).alias("y"))
    box = geometry.mouth_box(point, face).alias("b")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", box).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("b.width").alias("w"), F.col("b.height").alias("h"), "b.x", "b.y")


@query(
    f"""WITH {KEYPOINTS_SQL}, q AS (SELECT vec_id, points[1] * 100 AS ax, points[3] * 100 AS bx, points[2] * 100 AS ay, points[4] * 100 AS by_, points[5] * 100 AS ux, points[7] * 100 AS lx FROM keypoints),
d AS (SELECT *, sqrt((ax - bx) ** 2 + (ay - by_) ** 2) >= 15 AS fits, greatest(8, round_even((40 + vec_id % 30) * 0.45, 0)) AS w FROM q)
SELECT vec_id, CASE WHEN fits THEN floor(least(ux, lx)) ELSE round_even(ux - w / 2, 0) END::INT AS x, CASE WHEN fits THEN greatest(1, ceil(greatest(ux, lx)) - floor(least(ux, lx))) ELSE w END::INT AS width FROM d"""
)
def measured_or_approximate_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lips' own box where the eyes are far enough apart to measure them, else one about the upper lip, sized by the face."""
    mesh = F.transform(_points(), lambda p: F.struct((p["x"] * 100).alias("x"), (p["y"] * 100).alias("y")))
    rows = keypoints(spark, sf_dir).select("vec_id", mesh.alias("mesh"))
    contour = F.when(geometry.distance(F.col("mesh")[0], F.col("mesh")[1]) >= 15, F.slice("mesh", 3, 2))
    face = geometry.box(F.lit(0), F.lit(0), 40 + F.col("vec_id") % 30, F.lit(60))
    box = geometry.best_mouth_box(contour, F.col("mesh")[2], face)
    return rows.select("vec_id", box["x"].alias("x"), box["width"].alias("width"))


@query("SELECT event_id, event_type <> 'error' AS detected, CASE WHEN event_type <> 'error' THEN value END AS value FROM events")
def frame_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames with their detection, if any: events that are no errors detect."""
    rows = table(spark, sf_dir, "events")
    found = rows.where("event_type <> 'error'").select("event_id", "value")
    return tracking.with_detections(rows.select("event_id"), found, ["event_id"], "value").select("event_id", "detected", "value")


@query(
    """SELECT p_partkey, CASE WHEN greatest(w, h) <= 640 THEN w ELSE greatest(1, round_even(w * (640 / greatest(w, h)), 0)) END::INT AS width, CASE WHEN greatest(w, h) <= 640 THEN h ELSE greatest(1, round_even(h * (640 / greatest(w, h)), 0)) END::INT AS height
FROM (SELECT p_partkey, p_size * 40 AS w, 1 + p_partkey % 900 AS h FROM part)"""
)
def fit_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = geometry.fit_long_side(F.col("p_size") * 40, 1 + F.col("p_partkey") % 900, 640)
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.*")


@query(
    """WITH c AS (SELECT p_partkey, (p_size * 11) % 640 + 0.5 AS x, p_partkey % 480 AS y FROM part)
SELECT p_partkey, greatest(0, round_even(x - 48, 0))::INT AS x0, least(640, round_even(x + 48, 0))::INT AS x1, greatest(0, -round_even(x - 48, 0))::INT AS pad_x0, greatest(0, round_even(x + 48, 0) - 640)::INT AS pad_x1,
greatest(0, y - 48)::INT AS y0, least(480, y + 48)::INT AS y1, greatest(0, 48 - y)::INT AS pad_y0, greatest(0, y + 48 - 480)::INT AS pad_y1 FROM c"""
)
def crop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = geometry.crop_window((F.col("p_size") * 11) % 640 + 0.5, F.col("p_partkey") % 480, 96, F.lit(640), F.lit(480))
    return table(spark, sf_dir, "part").select("p_partkey", window.alias("w")).select("p_partkey", "w.*")


# --- points and images: the first eight numbers of a vector are four points, all 64 an 8 x 8 image

# Where the four points of an upright face lie, in a frame of 256.
_REFERENCE = ((89.3, 94.6), (169.5, 94.6), (129.4, 141.2), (129.4, 183.5))


def _points():
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.get("points", i * 2).alias("x"), F.get("points", i * 2 + 1).alias("y")))


_REF_SQL = "r AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(_REFERENCE)) + ") v(i, u, v))"


@query(
    f"""WITH {KEYPOINTS_SQL}, {_REF_SQL}, p AS (SELECT vec_id, i, points[2 * i - 1] AS x, points[2 * i] AS y, u, v FROM keypoints, r),
c AS (SELECT vec_id, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM p GROUP BY 1),
s AS (SELECT p.vec_id, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv, sum((x - mx) ** 2 + (y - my) ** 2) AS q, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) AS d, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) AS k FROM p JOIN c USING (vec_id) GROUP BY p.vec_id)
SELECT vec_id, round(d / q, 5) AS a, round(k / q, 5) AS c, round(mu - d / q * mx + k / q * my, 4) AS tx, round(mv - k / q * mx - d / q * my, 4) AS ty FROM s"""
)
def similarity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _REFERENCE))
    rows = keypoints(spark, sf_dir).select("vec_id", geometry.similarity_fit(_points(), reference).alias("m"))
    return rows.select("vec_id", F.round("m.a", 5).alias("a"), F.round("m.c", 5).alias("c"), F.round("m.tx", 4).alias("tx"), F.round("m.ty", 4).alias("ty"))


@query(f"WITH {KEYPOINTS_SQL} SELECT vec_id, " + ", ".join(f"round(0.8 * points[{2 * i - 1}] - 0.6 * points[{2 * i}] + 3, 6) AS x{i}, round(0.6 * points[{2 * i - 1}] + 0.8 * points[{2 * i}] - 1, 6) AS y{i}" for i in range(1, 5)) + " FROM keypoints")
def transform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.struct(*(F.lit(v).alias(k) for k, v in {"a": 0.8, "b": -0.6, "tx": 3.0, "c": 0.6, "d": 0.8, "ty": -1.0}.items()))
    rows = keypoints(spark, sf_dir).select("vec_id", geometry.transform_points(_points(), m).alias("p"))
    return rows.select("vec_id", *(F.round(F.col("p")[i][k], 6).alias(f"{k}{i + 1}") for i in range(4) for k in "xy"))


@query(
    f"""WITH {KEYPOINTS_SQL}, q AS (SELECT vec_id, points[1] * 100 AS ax, points[2] * 100 AS ay, points[3] * 100 AS bx, points[4] * 100 AS by_, points[5] * 100 AS ux, points[6] * 100 AS uy, points[7] * 100 AS lx, points[8] * 100 AS ly FROM keypoints),
d AS (SELECT *, sqrt((ax - bx) ** 2 + (ay - by_) ** 2) AS io FROM q)
SELECT vec_id, round(sqrt((ux - lx) ** 2 + (uy - ly) ** 2) / io, 6) AS aperture, round((ux + lx) / 2, 6) AS centre_x, floor(least(ux, lx, ax))::INT AS x, greatest(1, ceil(greatest(ux, lx, ax)) - floor(least(ux, lx, ax)))::INT AS width FROM d WHERE io >= 1"""
)
def mouth_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four points stand for two eyes and two lips."""
    mesh = F.transform(_points(), lambda p: F.struct((p["x"] * 100).alias("x"), (p["y"] * 100).alias("y")))
    rows = keypoints(spark, sf_dir).select("vec_id", mesh.alias("mesh"))
    rows = rows.withColumn("s", geometry.mouth_shape(F.col("mesh"), (0, 1), (2, 3), (2, 3), (2, 3, 0))).where("s is not null")
    box = geometry.contour_box(F.col("s.contour"))
    return rows.select("vec_id", F.round("s.aperture", 6).alias("aperture"), F.round("s.centre.x", 6).alias("centre_x"), box["x"].alias("x"), box["width"].alias("width"))


@query(
    f"""WITH {KEYPOINTS_SQL} SELECT vec_id, {", ".join(f"round((points[{2 * a + k}] + points[{2 * a + 2 + k}]) / 2 - 16, 9) AS {'xy'[k - 1]}{i}" for i, a in ((1, 0), (2, 2)) for k in (1, 2))} FROM keypoints"""
)
def reference_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of two groups of two points, moved from a frame of 128 to one of 96."""
    rows = keypoints(spark, sf_dir).select("vec_id", geometry.reference_points(_points(), ((0, 2), (2, 4)), 128, 96).alias("r"))
    return rows.select("vec_id", *(F.round(F.col("r")[i][k], 9).alias(f"{k}{i + 1}") for i in (0, 1) for k in "xy"))


@query()
def robust_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit that outliers do not move; ``tests/test_operators.py`` holds it against brute force."""
    reference = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _REFERENCE))
    rows = keypoints(spark, sf_dir).select("vec_id", geometry.robust_fit(_points(), reference, 4).alias("m"))
    return rows.select("vec_id", *(F.round(F.col("m")[k], 5).alias(k) for k in ("a", "c", "tx", "ty")))


@query(
    """SELECT p_partkey, '{"mouth_detected":' || (p_size > 10) || ',"energy":' || (p_partkey % 100 / 100)::DOUBLE || ',"face_box":' || CASE WHEN p_size > 10 THEN '{"x":1,"y":2,"width":' || p_size || ',"height":9}' ELSE 'null' END ||
',"mouth_box":null,"frame_height":480,"frame_width":640}' AS json FROM part"""
)
def status_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    face = F.when(F.col("p_size") > 10, geometry.box(F.lit(1), F.lit(2), F.col("p_size"), F.lit(9)))
    json = geometry.status_json(F.col("p_size") > 10, F.col("p_partkey") % 100 / 100, face, F.lit(None).cast("struct<x:int,y:int,width:int,height:int>"), F.lit(480), F.lit(640))
    return table(spark, sf_dir, "part").select("p_partkey", json.alias("json"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 100)
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(pixels, i * 8 + 1, 8))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", rows.alias("image"))


@query("SELECT vec_id, " + ", ".join(f"round((abs(embedding[{r * 8 + c + 1}]::DOUBLE) * 100 / 255 - 0.421) / 0.165, 6) AS p{r}{c}" for r in range(1, 7) for c in range(1, 7)) + " FROM embeddings")
def normalised_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle 6 x 6 pixels in standard units."""
    rows = images(spark, sf_dir).select("vec_id", tensor.normalise(tensor.centre_crop(F.col("image"), 6)).alias("t"))
    return rows.select("vec_id", *(F.round(F.col("t")[r - 1][c - 1], 6).alias(f"p{r}{c}") for r in range(1, 7) for c in range(1, 7)))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: round_even(greatest(0, least(1, x::DOUBLE * 0.165 + 0.421)) * 255, 0)::INT), ',') AS pixels FROM embeddings")
def denormalised_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.transform("embedding", lambda x: x.cast("double")), i * 8 + 1, 8))
    whole = F.flatten(tensor.denormalise(raw))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(whole, ",").alias("pixels"))


@query("SELECT label, count(*) AS frames, 8 AS height, 8 AS width, true AS regular, 3 AS channels FROM embeddings GROUP BY label")
def stacked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of every label's images, stacked in order as one nested list with three channels; no list is built, a label may have any number."""
    rows = images(spark, sf_dir).select("label", "vec_id", tensor.shape(F.array("image")).alias("s"), F.size(tensor.promote(F.col("image"))[0][0]).alias("channels"))
    rows = rows.select("label", "vec_id", "s.height", "s.width", "s.regular", "channels")
    same = F.every("regular") & (F.min("height") == F.max("height")) & (F.min("width") == F.max("width"))
    first = F.min(F.struct("vec_id", "height", "width", "channels")).alias("first")
    found = rows.groupBy("label").agg(F.count("*").alias("frames"), first, same.alias("regular"))
    return found.select("label", "frames", "first.height", "first.width", "regular", "first.channels")


def byte_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding is an image of 8 x 8 bytes; every third vector has three channels."""
    value = lambda x: F.least(F.lit(255), F.rint(F.abs(x.cast("double")) * 1000)).cast("int")
    hexed = F.transform("embedding", lambda x: F.lpad(F.hex(value(x).cast("long")), 2, "0"))
    colour = F.col("vec_id") % 3 == 0
    pixels = F.unhex(F.array_join(F.transform(hexed, lambda h: F.when(colour, F.repeat(h, 3)).otherwise(h)), ""))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(8).alias("height"), F.lit(8).alias("width"), F.when(colour, 3).otherwise(1).alias("channels"), pixels.alias("pixels"))


@query("SELECT 'sample_' || doc_id AS stem, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS transcript FROM documents WHERE text IS NOT NULL")
def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a text file, read again as a transcript."""
    path = f"{folder_of(spark, 'transcripts')}/txt"
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("sample_"), "doc_id", F.lit(".txt")).alias("name"), "text")
    files.write_files(rows, path, "name", "text", 1024)
    return files.read_transcripts(spark, path, 1024)


@query(
    """WITH h AS (SELECT vec_id, vec_id % 7 = 0 AS broken, list_transform(embedding, lambda x: printf('%02X', least(255, round_even(abs(x::DOUBLE) * 1000, 0))::INT)) AS h FROM embeddings)
SELECT 'still_' || vec_id || '.bmp' AS name, CASE WHEN broken THEN -1 ELSE 8 END AS width, CASE WHEN broken THEN -1 ELSE 8 END AS height, NOT broken AS valid,
  CASE WHEN NOT broken THEN array_to_string(list_transform(h, lambda x: repeat(x, 3)), '') END AS pixels FROM h"""
)
def still_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as an image file of 8 x 8 pixels, each seventh cut short, read again with its pixels."""
    head = "424D" + "F6000000" + "00000000" + "36000000" + "28000000" + "08000000" + "08000000" + "0100" + "1800" + "00000000" + "C0000000" + "00000000" * 4
    bytes_ = F.transform("embedding", lambda x: F.repeat(F.lpad(F.hex(F.least(F.lit(255), F.rint(F.abs(x.cast("double")) * 1000)).cast("long")), 2, "0"), 3))
    upside_down = F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0)), lambda r: F.array_join(F.slice(bytes_, r * 8 + 1, 8), "")), "")
    content = F.when(F.col("vec_id") % 7 == 0, F.lit(head[:20])).otherwise(F.concat(F.lit(head), upside_down))
    path = f"{folder_of(spark, 'stills')}/bmp"
    files.write_files(table(spark, sf_dir, "embeddings").select(F.concat(F.lit("still_"), "vec_id", F.lit(".bmp")).alias("name"), F.unhex(content).alias("content")), path, "name", "content")
    found = files.read_stills(spark, path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "width", "height", "valid", F.hex("data").alias("pixels"))


_BYTE = "printf('%02X', least(255, round_even(abs(x::DOUBLE) * 1000, 0))::INT)"


@query(
    f"""WITH i AS (SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 40 AS block, list_transform(embedding, lambda x: {_BYTE}) AS h FROM embeddings),
c AS (SELECT label, block, max(CASE WHEN vec_id % 3 = 0 THEN 3 ELSE 1 END) AS channels, count(*) AS frames FROM i GROUP BY ALL)
SELECT label, block, any_value(frames) AS frames, 8 AS height, 8 AS width, any_value(channels) AS channels, string_agg(array_to_string(list_transform(h, lambda x: repeat(x, channels)), ''), '' ORDER BY vec_id) AS pixels FROM i JOIN c USING (label, block) GROUP BY label, block"""
)
def stacked_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label's images stacked in order, forty to a block, with all their pixels; grey ones get the channels of the others."""
    found = pixels.stack(byte_images(spark, sf_dir), "label", "vec_id", 40)
    return found.select("label", "block", F.col("frames").cast("long").alias("frames"), "height", "width", "channels", F.hex("pixels").alias("pixels"))


@query(
    f"""WITH i AS (SELECT vec_id, vec_id % 3 = 0 AS colour, list_transform(embedding, lambda x: {_BYTE}) AS h, round_even(vec_id % 11 - 0.5 - 3, 0)::INT AS x0, round_even(vec_id % 9 - 3, 0)::INT AS y0 FROM embeddings)
SELECT vec_id, array_to_string(list_transform(range(0, 36), lambda k: repeat(CASE WHEN x0 + k % 6 BETWEEN 0 AND 7 AND y0 + k // 6 BETWEEN 0 AND 7 THEN h[(y0 + k // 6) * 8 + x0 + k % 6 + 1] ELSE '00' END, CASE WHEN colour THEN 3 ELSE 1 END)), '') AS pixels FROM i"""
)
def cropped_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six by six pixels around a point of each image; many run past its edges."""
    rows = byte_images(spark, sf_dir).withColumn("x", F.col("vec_id") % 11 - 0.5).withColumn("y", (F.col("vec_id") % 9).cast("double"))
    return pixels.crop(rows, "x", "y", 6).select("vec_id", F.hex("pixels").alias("pixels"))


#: A label is a clip of a hundred frames a second; every fifth frame misses its subject, most of label 7 and all of label 3.
_SEEN = "vec_id % 5 <> 0 AND label <> 3 AND (label <> 7 OR vec_id % 6 = 1)"
_OFFLINE = Preprocessing(crop=6)


@query(
    f"""WITH f AS (SELECT label, vec_id, vec_id * 0.01::DOUBLE AS t, CASE WHEN {_SEEN} THEN list_transform(embedding[1:8], lambda x: x::DOUBLE * 20 + 3.5) END AS points, list_transform(embedding, lambda x: least(255, round_even(abs(x::DOUBLE) * 1000, 0))::INT) AS h, CASE WHEN vec_id % 3 = 0 THEN 3 ELSE 1 END AS channels FROM embeddings),
ends AS (SELECT label, min(t) AS a, max(t) AS b FROM f GROUP BY 1),
grid AS (SELECT label, n, a + n / 25.0::DOUBLE AS target FROM (SELECT label, a, unnest(range(0, least(1500, floor((b - a) * 25 + 1e-6)::BIGINT + 1))) AS n FROM ends)),
near AS (SELECT g.label, n, vec_id FROM grid g JOIN f ON g.label = f.label AND t BETWEEN target - 3 AND target + 3 QUALIFY row_number() OVER (PARTITION BY g.label, n ORDER BY abs(t - target), t) = 1),
s AS (SELECT near.label, n, points, h, channels FROM near JOIN f USING (vec_id)),
k AS (SELECT *, max(CASE WHEN points IS NOT NULL THEN n END) OVER (PARTITION BY label ORDER BY n ROWS UNBOUNDED PRECEDING) AS p, min(CASE WHEN points IS NOT NULL THEN n END) OVER (PARTITION BY label ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM s),
filled AS (SELECT k.label, k.n, k.points IS NOT NULL AS detected, k.h, k.channels, CASE WHEN k.points IS NOT NULL THEN k.points WHEN p IS NOT NULL AND q IS NOT NULL THEN list_transform(range(1, 9), lambda j: a.points[j] + (k.n - p) / (q - p) * (b.points[j] - a.points[j])) ELSE coalesce(a.points, b.points) END AS points
  FROM k LEFT JOIN s a ON a.label = k.label AND a.n = p LEFT JOIN s b ON b.label = k.label AND b.n = q),
m AS (SELECT *, least(6, n, count(*) OVER (PARTITION BY label) - 1 - n) AS m FROM filled WHERE points IS NOT NULL),
means AS (SELECT x.label, x.n, any_value(x.points) AS own, {", ".join(f"avg(y.points[{j}]) AS s{j}" for j in range(1, 9))} FROM m x JOIN m y ON x.label = y.label AND y.n BETWEEN x.n - x.m AND x.n + x.m GROUP BY ALL),
corner AS (SELECT label, n, round_even((own[1] + own[3] + own[5] + own[7]) / 4 - 3, 0)::INT AS x0, round_even((own[2] + own[4] + own[6] + own[8]) / 4 - 3, 0)::INT AS y0 FROM means),
cut AS (SELECT label, n, channels * list_sum(list_transform(range(0, 36), lambda j: CASE WHEN x0 + j % 6 BETWEEN 0 AND 7 AND y0 + j // 6 BETWEEN 0 AND 7 THEN h[(y0 + j // 6) * 8 + x0 + j % 6 + 1] ELSE 0 END)) AS total FROM corner JOIN filled USING (label, n)),
c AS (SELECT label, count(*) AS total_frames, count(*) FILTER (WHERE detected) / count(*) AS ratio, sum(total) AS total FROM filled LEFT JOIN cut USING (label, n) GROUP BY label)
SELECT label::VARCHAR AS clip_id, total_frames, round(ratio, 6) AS detection_ratio, ratio >= 0.3 AS mouth_detected, CASE WHEN ratio >= 0.3 AND total_frames >= 8 THEN total_frames || ' ' || total END AS text, NOT (ratio >= 0.3 AND total_frames >= 8) AS failed FROM c"""
)
def offline_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips through the offline path: sampled, filled, smoothed, cropped, scored (here by the sum of their pixels), with their outcome."""
    points = F.when(F.expr(_SEEN), F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 20 + 3.5))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", points.alias("points"))
    frames = byte_images(spark, sf_dir).join(vectors, "vec_id").withColumn("t", F.col("vec_id") * F.lit(0.01)).drop("vec_id")
    rows = offline.sampled(frames, "label", "t", "points", _OFFLINE)
    found = offline.transcripts(offline.patches(rows, "points", _OFFLINE), "label", _pixel_sum, _OFFLINE)
    return found.select("clip_id", "total_frames", F.round("detection_ratio", 6).alias("detection_ratio"), "mouth_detected", "text", F.col("error").isNotNull().alias("failed"))


def _pixel_sum():
    """A scorer that adds up all bytes of a clip's patches."""
    return lambda rows: [(f"{len(rows)} {sum(sum(x) for x in rows['pixels'])}", 0.0, [])]


# --- files: a page is a file, its address the name

_TYPES = ["video/mp4", "video/webm", "application/octet-stream"]
_STATUS = "CASE WHEN kind <> '' AND kind NOT IN ('video/mp4', 'video/webm', 'application/octet-stream') THEN 415 WHEN size = 0 THEN 400 WHEN size > 5000 THEN 413 ELSE 200 END"


@query(
    f"""WITH p AS (SELECT page_id, url, strlen(html) AS size, CASE page_id % 4 WHEN 0 THEN 'Video/MP4; codecs=avc1' WHEN 1 THEN '' WHEN 2 THEN 'text/plain' ELSE ' video/webm ' END AS ct FROM pages), k AS (SELECT *, lower(trim(string_split(ct, ';')[1])) AS kind FROM p)
SELECT page_id, {_STATUS} AS status_code, CASE WHEN regexp_extract(lower(url), '(\\.[^./]+)$', 1) IN ('.mp4', '.mov', '.webm', '.mkv', '.avi', '.html') THEN regexp_extract(lower(url), '(\\.[^./]+)$', 1) ELSE '.mp4' END AS suffix FROM k"""
)
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    kind = F.element_at(F.array(*map(F.lit, ["Video/MP4; codecs=avc1", "", "text/plain", " video/webm "])), (F.col("page_id") % 4 + 1).cast("int"))
    status = files.admission(kind, F.octet_length("html"), _TYPES, 5000)
    return rows.select("page_id", status.alias("status_code"), files.suffix(F.col("url"), (*files.ALLOWED_SUFFIXES, ".html")).alias("suffix"))


@query(
    """WITH f AS (SELECT page_id, sha256(html) AS s FROM pages WHERE page_id % 5 <> 0), c AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN repeat('0', 64) ELSE sha256(html) END AS expected FROM pages)
SELECT c.page_id, CASE WHEN s IS NULL THEN 'missing' WHEN s = expected THEN 'present' ELSE 'corrupt' END AS status FROM c LEFT JOIN f USING (page_id)"""
)
def file_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the files is missing, a third has another sum in the catalogue."""
    pages = table(spark, sf_dir, "pages")
    catalog = pages.select("page_id", F.when(F.col("page_id") % 3 == 0, "0" * 64).otherwise(F.sha2("html", 256)).alias("expected"))
    found = files.integrity(catalog, pages.where("page_id % 5 <> 0"), "page_id", "expected", F.col("html"))
    return found.select("page_id", "status")


@query("WITH n AS (SELECT max(event_id) AS latest FROM events) SELECT event_id FROM events, n WHERE event_id < latest - 900")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event numbers stand for seconds of modification."""
    rows = table(spark, sf_dir, "events")
    asof = rows.agg(F.max("event_id")).first()[0]
    return files.expired(rows, F.col("event_id"), F.lit(asof), 900).select("event_id")


@query(
    """WITH c AS (SELECT p_partkey, p_size * 10 AS w, 480 AS h, (p_partkey % 9) * 90 - 180 AS r, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice / 100 END AS a, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice / 50 END AS b, CASE WHEN p_partkey % 5 > 0 THEN 25.0 END AS f FROM part),
t AS (SELECT *, (r % 360 + 360) % 360 AS turn FROM c)
SELECT p_partkey, CASE WHEN turn IN (90, 270) THEN h ELSE w END AS width, CASE WHEN turn IN (90, 270) THEN w ELSE h END AS height, turn AS rotation, round(coalesce(a, b, 0), 4) AS duration_s, coalesce(f, 0)::DOUBLE AS fps FROM t"""
)
def clip_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    clip = files.normalise_clip(
        F.col("p_size") * 10, F.lit(480), (k % 9) * 90 - 180, F.when(k % 3 == 0, F.col("p_retailprice") / 100), F.when(k % 2 == 0, F.col("p_retailprice") / 50), F.when(k % 5 > 0, F.lit(25.0))
    )
    return table(spark, sf_dir, "part").select("p_partkey", clip.alias("c")).select("p_partkey", "c.width", "c.height", "c.rotation", F.round("c.duration_s", 4).alias("duration_s"), "c.fps")


@query(
    """SELECT event_id, round(coalesce(CASE WHEN event_id % 3 > 0 THEN event_id * 512 END * (1 / 12800), event_id / coalesce(CASE WHEN event_id % 2 = 0 THEN 30.0 END, 25)), 6) AS t,
trunc((value - event_id % 7) * 1000)::BIGINT AS elapsed_ms FROM events"""
)
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackframe.functions.timing import elapsed_ms, frame_time

    k = F.col("event_id")
    t = frame_time(F.when(k % 3 > 0, k * 512), F.lit(1 / 12800), k, F.when(k % 2 == 0, F.lit(30.0)))
    return table(spark, sf_dir, "events").select("event_id", F.round(t, 6).alias("t"), elapsed_ms(F.col("event_id") % 7, F.col("value")).alias("elapsed_ms"))


@query("SELECT 'sample_' || CASE WHEN doc_id < 10 THEN '0' ELSE '' END || doc_id AS file, n_chars AS frames, round_even(n_chars / 30, 2) AS seconds, greatest(1, trunc(n_chars / 30 * 25))::INT AS expected_frames_at_25fps FROM documents")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.format_string("sample_%02d", "doc_id").alias("file"), F.col("n_chars").alias("frames"), F.lit(30.0).alias("fps"))
    return files.manifest_columns(rows, "frames", "fps").drop("fps")


@query("SELECT doc_id, text, source FROM documents ORDER BY doc_id LIMIT 5")
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source").orderBy("doc_id").limit(5)


@query("SELECT d.doc_id, quality, text AS transcript FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def manifest_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for a manifest, documents for its transcripts."""
    stems = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("transcript"))
    return table(spark, sf_dir, "labels").join(stems, "doc_id").select("doc_id", "quality", "transcript")


@query("SELECT count(*) AS rows, (SELECT count(*) FROM (DESCRIBE lineitem)) AS columns, 1::BIGINT AS files, true AS by_footers FROM lineitem")
def describe_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, columns and files of a dataset; the footers, with their row groups, tell as many rows as a scan."""
    path = f"{sf_dir}/lineitem.parquet"
    scanned = files.describe(spark, path).agg(F.sum("rows").alias("rows"))
    told = files.row_groups(spark, path).agg(F.sum("rows").alias("rows"), F.max("columns").cast("long").alias("columns"), F.count("*").alias("files"), F.min("row_groups").alias("least")).first()
    return scanned.select("rows", F.lit(told.columns).alias("columns"), F.lit(told.files).alias("files"), ((F.col("rows") == told.rows) & F.lit(told.least > 0)).alias("by_footers"))


@query("SELECT 'sample_' || CASE WHEN doc_id < 10 THEN '0' ELSE '' END || doc_id AS file, n_chars AS frames, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS transcript FROM documents")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest as it is written, read again by its schema."""
    rows = table(spark, sf_dir, "documents").select(F.format_string("sample_%02d", "doc_id").alias("file"), F.col("n_chars").cast("int").alias("frames"), F.lit(30.0).alias("fps"), F.btrim("text", F.lit(" \t\n\r")).alias("transcript"))
    folder = folder_of(spark, "manifest")
    files.write_manifest(rows, folder)
    return files.read_manifest(spark, folder, lines=True).select("file", "frames", "transcript")


@query("WITH n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey, p // s AS nth, p // s // 4 AS sheet_row, (p // s) % 4 AS sheet_column FROM (SELECT o_orderkey, o_orderkey AS p, greatest(1, n // 12) AS s FROM orders, n) WHERE p % s = 0 AND p < s * 12")
def contact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve evenly spaced rows on a sheet of four columns."""
    rows = table(spark, sf_dir, "orders")
    total = rows.count()
    found = files.systematic_sample(rows, "o_orderkey", total, 12, 4)
    return found.select("o_orderkey", (F.col("sheet_row") * 4 + F.col("sheet_column")).alias("nth"), "sheet_row", "sheet_column")


@query(
    """WITH k AS (SELECT DISTINCT p_type || '.' || p_name AS key FROM part), m AS (SELECT key, CASE WHEN starts_with(key, 'ECONOMY.') THEN 'encoder.' || key[9:] WHEN starts_with(key, 'STANDARD.') THEN 'decoder.' || key[10:] ELSE key END AS new_key FROM k) SELECT key, new_key FROM m"""
)
def key_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "part").select(F.concat_ws(".", "p_type", "p_name").alias("key")).distinct()
    return files.rewrite_keys(keys, "key", [("ECONOMY.", "encoder."), ("STANDARD.", "decoder.")], "ECONOMY.")


@query(
    """WITH p AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_custkey % 3 > 0 AND c_nationkey <> 4), r AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey > 2)
SELECT 'n' || coalesce(p.k, r.k) AS key, CASE WHEN p.k IS NOT NULL AND r.k IS NOT NULL THEN 'loaded' WHEN p.k IS NOT NULL THEN 'unexpected' WHEN starts_with('n' || r.k, 'n1') THEN 'ignorable' ELSE 'missing' END AS status FROM p FULL JOIN r ON p.k = r.k"""
)
def key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers against those that suppliers require."""
    named = lambda c: F.concat(F.lit("n"), F.col(c).cast("string")).alias("key")
    present = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0 and c_nationkey <> 4").select(named("c_nationkey"))
    required = table(spark, sf_dir, "supplier").where("s_nationkey > 2").select(named("s_nationkey"))
    return files.compare_keys(present, required, "key", ("n1",))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def missing_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no large order line has."""
    present = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return files.missing(table(spark, sf_dir, "part"), present, "p_partkey").select("p_partkey", "p_name")


@query(
    """SELECT s_suppkey, n_name, CASE WHEN n_name IS NULL THEN 'Unknown key ''' || s_nationkey || '''. Known: ' || (SELECT string_agg(n_nationkey::VARCHAR, ', ' ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 9) END AS error
FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 9) n ON s_nationkey = n_nationkey"""
)
def catalogue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = table(spark, sf_dir, "nation").where("n_nationkey < 9").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return files.look_up(table(spark, sf_dir, "supplier"), catalog, "s_nationkey", "n_name").select("s_suppkey", "n_name", "error")


@query(
    """WITH u AS (SELECT c_mktsegment AS name, count(*) AS uses FROM customer GROUP BY 1)
SELECT name, uses, name IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AS registered, name IN ('BUILDING', 'MACHINERY') AS implemented,
CASE WHEN name IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN '' ELSE 'Unknown model ' || chr(39) || name || chr(39) || '. Known: AUTOMOBILE, BUILDING, MACHINERY' END AS error FROM u ORDER BY name"""
)
def implemented_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the registry says of every name in use, sorted: registered, implemented, or an error that lists the known ones."""
    registry = scorers.Registry()
    for name in ("BUILDING", "MACHINERY"):
        registry.register(name, lambda: lambda rows: [])
    registry.register("AUTOMOBILE", None)
    known = spark.createDataFrame(list(registry.available().items()), "name string, implemented boolean")
    names = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("uses"))
    rows = names.join(F.broadcast(known), "name", "left").withColumn("registered", F.col("implemented").isNotNull())
    unknown = F.concat(F.lit("Unknown model '"), F.col("name"), F.lit(f"'. Known: {', '.join(registry.available())}"))
    return rows.select("name", "uses", "registered", F.coalesce("implemented", F.lit(False)).alias("implemented"), F.when(F.col("registered"), "").otherwise(unknown).alias("error")).orderBy("name")


@query("SELECT doc_id AS clip_id, CASE WHEN toxic = 1 THEN 'quiet' ELSE 'speech' END AS label, 'labels' AS origin FROM labels UNION ALL SELECT item_id, 'speech', 'benchmark' FROM benchmark")
def labelled_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("clip_id"), F.when(F.col("toxic") == 1, "quiet").otherwise("speech").alias("label"), F.lit("labels").alias("origin"))
    return labelled.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("clip_id"), F.lit("speech").alias("label"), F.lit("benchmark").alias("origin")))


@query(
    """SELECT event_id, CASE WHEN NOT json_valid(m) THEN 'error' WHEN m->>'$.type' IN ('ping', 'flush', 'reset', 'close') THEN m->>'$.type' ELSE 'unknown' END AS action
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"type":"ping"}' WHEN 1 THEN '{"type":"flush","x":1}' WHEN 2 THEN '{"type"' WHEN 3 THEN '{"type":"dance"}' ELSE '{}' END AS m FROM events)"""
)
def control_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = F.array(*map(F.lit, ['{"type":"ping"}', '{"type":"flush","x":1}', '{"type"', '{"type":"dance"}', "{}"]))
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(messages, (F.col("event_id") % 5 + 1).cast("int")).alias("m"))
    from trackframe.streaming.control import action

    return rows.select("event_id", action(F.col("m")).alias("action"))
