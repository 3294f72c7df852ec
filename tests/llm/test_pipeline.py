"""The pipeline's stages, each against a brute-force version of its decision."""

from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.llm import test_decontamination, test_packing, test_quality, test_secrets, test_simhash
from trackframe.llm import common, packing, quality
from trackframe.llm.common import materialize

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def plainly_rejected(spark, docs, labels):
    """Ids that plain co-training scores below one half."""
    order, fold = F.xxhash64("text_view", "meta_view").alias("o"), F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(4)).alias("f")
    own = quality.feature_rows(docs).select("id", "text_view", "meta_view", order, fold).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    scores = test_quality.plain_co_training(own, {r.id: known[r.id] for r in own if r.id in known}, {r.id: r.f for r in own}, {r.id: r.o for r in own})
    return {i for i, s in scores.items() if s < quality.THRESHOLD}


def test_every_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, labels = rows(docs), spark.read.parquet(f"{SF}/labels.parquet")

    one = materialize(p.quality_stage(spark, docs, SF), "t")
    assert one.schema.names == docs.schema.names
    assert set(rows(one)) == set(before) - plainly_rejected(spark, docs, labels)

    two = materialize(p.near_duplicate_stage(spark, one, SF), "t")
    prints = {i: test_simhash.plain_fingerprint(r.text) for i, r in rows(one).items()}
    root = test_simhash.brute_components(set(prints.values()))
    assert set(rows(two)) == {min(i for i, f in prints.items() if root[f] == g) for g in set(root.values())}

    three = materialize(p.decontamination_stage(spark, two, SF), "t")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {i for i, _ in test_decontamination.all_leaks([(i, r.text) for i, r in rows(two).items()], items)}
    assert leaked and set(rows(three)) == set(rows(two)) - leaked

    four = materialize(p.secrets_stage(spark, three, SF), "t")
    assert four.schema.names == docs.schema.names
    kept = rows(three)
    for i, r in rows(four).items():
        if not test_secrets.brute(kept[i].text):
            assert r == kept[i] or "<SECRET>" in r.text
        else:
            assert "<SECRET>" in r.text and r.n_chars == len(r.text) and not [s for s in test_secrets.brute(r.text) if s[2] != "assign"]

    five = p.packing_stage(spark, four, SF).collect()
    assert {r.doc_id for r in five} == set(kept)
    test_packing.holds(five)


def test_run_equals_stages(spark):
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    assert p.run(spark, SF).count() > 100


def test_edges(spark):
    kind = spark.read.parquet(f"{SF}/documents.parquet").schema
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    odd = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (None, "token=abcdefgh 1", "en", "a", 16), (None, "token=abcdefgh 1", "en", "a", 16)]
    odd = spark.createDataFrame([*odd, (5, "x " * 50_000, "en", "a", 100_000), (None, f"so {item}", "en", "a", 1), (7, "an own text", "fr", "b", 11), (7, "of the same id", "fr", "b", 14)], kind)
    docs = odd
    for _, stage in p.STAGES[1:-1]:
        docs = materialize(stage(spark, docs, SF), "t")
    # of copies one stays, with a null id too; the leak goes
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "5", "7", "7", "None"]
    assert "<SECRET>" in docs.where("doc_id is null").first().text
    for _, stage in p.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_clashing_columns_go_along(spark):
    """Names that stages use themselves, one with a dot, one that differs by case."""
    names = ["_row", "ROW", "__row", "base", "found", "kept", "changed", "clean", "bucket", "rank", "own", "id", "key", "_place", "label", "score", "a.b", "text_view"]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    own = [(1, "an own text with token=abcdefgh12345"), (2, f"so {item}"), (3, "an own text with token=abcdefgh12345"), (4, "something else is written here")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), *(f"{n}{i}" for n in names)) for i, t in own], ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{n}` string" for n in names)]))
    docs = materialize(docs, "t")
    for _, stage in p.STAGES[1:-1]:
        docs = materialize(stage(spark, docs, SF), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
    got = docs.orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(i, t, "en", "a", len(t), *(f"{n}{i}" for n in names)) for i, t in ((1, "an own text with <SECRET>"), (4, own[3][1]))]
    assert p.quality_stage(spark, docs, SF).columns == docs.columns
    assert p.packing_stage(spark, docs, SF).count() == 2


def test_clashing_columns_of_pieces(spark):
    names = ["row", "bucket", "own", "first", "rank", "n", "place"]
    pieces = spark.createDataFrame([(i, 0, 0, 5, 1, *(f"{n}{i}" for n in names)) for i in range(9)], "id long, piece int, start long, length long, ids_crc32 long, " + ", ".join(f"{n} string" for n in names))
    got = packing.pack(pieces).collect()
    assert sorted(tuple(r)[:-2] for r in got) == sorted(map(tuple, pieces.collect())) and len({(r.sequence_id, r.offset) for r in got}) == 9


def rows_beside(spark, kept, docs):
    """How many rows ``kept`` reads of other tables than ``docs``: those that its join broadcasts."""
    own = {f.rsplit("/", 1)[0] for f in docs.inputFiles()}
    return sum(spark.read.parquet(f).count() for f in {f.rsplit("/", 1)[0] for f in kept.inputFiles()} - own)


def test_dropped_copies_are_no_rows_of_a_broadcast(spark):
    kind = spark.read.parquet(f"{SF}/documents.parquet").schema
    copies = spark.range(40_000).selectExpr("id AS doc_id", "concat('copy of text ', id % 20, ' alone') AS text", "'en' AS lang", "'a' AS source", "1L AS n_chars")
    docs = materialize(copies.to(kind).repartition(2), "t")
    kept = p.near_duplicate_stage(spark, docs, SF)
    texts = {i: f"copy of text {i} alone" for i in range(20)}
    root = test_simhash.brute_components({test_simhash.plain_fingerprint(t) for t in texts.values()})
    groups = {}
    for i, t in texts.items():
        groups.setdefault(root[test_simhash.plain_fingerprint(t)], i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups.values())
    assert rows_beside(spark, kept, docs) <= 8


def test_rows_are_dropped_by_bits_or_by_keys(spark, monkeypatch):
    docs = materialize(spark.range(100_000).selectExpr("id", "id AS bits", "id % 7 AS `file`", "id AS `a.b`").repartition(2), "t")
    keyed = common.with_row_key(docs, "row")
    places = keyed.select(F.substring_index("row", ":", -1).cast("long").alias("at"), "row", "id")
    chosen = places.where("at IN (0, 1, 7, 8, 32766, 32767, 32768, 32769) OR pmod(xxhash64(id), 3) = 0")
    want = {r.id for r in places.collect()} - {r.id for r in chosen.collect()}
    for most in (common.BROADCAST_BITMAPS, 3):
        monkeypatch.setattr(common, "BROADCAST_BITMAPS", most)
        kept = common.without_rows(keyed, chosen.select("row").union(chosen.select("row")), "row")
        assert kept.schema.names == ["id", "bits", "file", "a.b", "row"]
        assert kept.count() == len(want) and {r.id for r in kept.collect()} == want
        assert common.without_rows(keyed, chosen.select("row").limit(0), "row").count() == 100_000
