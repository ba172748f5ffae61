"""Fixed expectations of single operators, and their edge cases."""

from pyspark.sql import functions as F

from foliate.functions import text as t
from foliate.operators import audit, chunks, claims, retrieval, sync


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_money_and_dates(spark):
    amounts = ["1.234,56", "1,234.56", "10.000.000", "9,5", "12 EUR", "none", None]
    got = [one(spark, t.money(F.lit(a).cast("string")))[0] for a in amounts]
    assert got == [1234.56, 1234.56, 10_000_000.0, 9.5, 12.0, None, None]
    assert [str(one(spark, t.day(F.lit(d)))[0]) for d in ("31.12.2020", "31/12/2020", "2020-12-31", "on 1.2.2020.", "31.02.2020")] == ["2020-12-31"] * 3 + ["2020-02-01", "None"]
    assert one(spark, t.days(F.lit("1/2/20 and 30.02.2021 and 03-04-2022")))[0] == ["01.02.2020", "03.04.2022"]


def test_variance(spark):
    assert one(spark, *claims.variance(F.lit(10_000_000.0), F.lit(9_500_000.0))) == (-500_000.0, -5.0)
    assert one(spark, *claims.variance(F.lit(0.0), F.lit(1.0)))[1] is None


def test_corroboration_counts_sources_once(spark):
    rows = spark.createDataFrame([("f", 0.0, 0.9, None, "d1"), ("f", 0.8, 0.7, 0.6, "d1"), ("f", None, 0.5, 0.4, "d2")], "k string, authority double, extraction double, classification double, source string")
    (r,) = claims.register_entries(rows, ["k"], "source").collect()
    assert (r.sources, r.score, r.level) == (2, round(0.57 * 0.8 + 0.25 * 0.9 + 0.06 + 0.05, 3), "medium")


def test_ocr_lines(spark):
    words = [(1, 1, 100, 200, 120, 40, 95.0, "Contract"), (1, 2, 230, 205, 100, 35, 75.0, "sum"), (2, 1, 100, 300, 90, 30, 90.0, "total"), (2, 2, 200, 300, 50, 30, 10.0, "x")]
    rows = chunks.ocr_lines(spark.createDataFrame(words, "n int, word_num int, left int, top int, width int, height int, conf double, text string"), ["n"], 30.0).orderBy("n").collect()
    assert [(r.left, r.top, r.right, r.bottom, r.confidence, r.line) for r in rows] == [(100, 200, 330, 240, 89.55, "Contract sum"), (100, 300, 190, 330, 90.0, "total")]


def test_articles(spark):
    df = spark.createDataFrame([(1, "intro\nArticle 1\nfirst\nArticle 2\nsecond\nmore"), (2, "none")], "id int, body string")
    assert [tuple(r) for r in chunks.articles(df, "body", "Article ([0-9]+)").collect()] == [(1, 0, "1", "first"), (1, 1, "2", "second\nmore")]


def test_routing_keeps_order_and_default(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "id int, x string")
    got = claims.routed(df, {"A": F.col("x").contains("a"), "B": F.col("x").contains("b")}, "other")
    assert sorted((r.id, r.register) for r in got.collect()) == [(1, "A"), (1, "B"), (2, "other")]


def test_snapshot_rename_is_unchanged(spark):
    kind = "key string, supported boolean, version string, md5 string, modified timestamp, size long, name string"
    refs = spark.createDataFrame([("a", True, "1", None, None, 1, "new name"), ("b", True, "2", None, None, 1, "b"), ("c", True, None, "m", None, 1, "c"), ("d", False, None, None, None, 1, "d")], kind)
    old = spark.createDataFrame([("a", "1", None, None, 1, "va", "active"), ("b", "1", None, None, 1, "vb", "active"), ("e", "1", None, None, 1, "ve", "active")], "key string, version string, md5 string, modified timestamp, size long, file_version_id string, status string")
    assert dict(map(tuple, sync.snapshot_diff(refs, old, "key").collect())) == {"a": "unchanged", "b": "changed", "c": "new", "d": "skipped", "e": "deleted"}


def test_aliases_and_groups(spark):
    types = spark.createDataFrame([("a",), ("b",)], "type string")
    alias = spark.createDataFrame([("a", "a2"), ("b", "b2")], "type string, alias string")
    assert audit.with_aliases(types, alias).count() == 4
    assert one(spark, audit.current_evidence(F.array(), F.array(F.lit(1))), audit.current_evidence(F.array(F.lit(1)), F.array(F.lit(1)))) == (False, True)


def test_ranking_drops_what_does_not_match(spark):
    rows = [("1", "claim", "Contractor: Example Ltd", 0.8, "c1"), ("2", "claim", "Location: somewhere", 0.9, "c2"), ("3", "law", None, 0.9, "c3")]
    df = spark.createDataFrame(rows, "id string, kind string, text string, authority double, chunk_id string")
    assert [r.id for r in retrieval.ranked(df, "who is the contractor", ["contractor"]).collect()] == ["1"]
