"""Literal cases of the small operators, each worked out by hand."""

import datetime

from pyspark.sql import functions as F

from foliate.functions import labels
from foliate.functions import text as t
from foliate.operators import access, audit, chunks, claims, evidence, extraction, retrieval, summaries, sync, verification, windows
from foliate.sources import files


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_access(spark):
    files_ = spark.createDataFrame([(1, "p"), (2, "q"), (3, "p"), (4, None)], "file_id int, project_id string")
    members = spark.createDataFrame([("p", 7), ("p", 8), ("r", 7)], "project_id string, user int")
    assert rows(access.of_members(files_, members, "project_id"), "file_id", "project_id") == [(1, "p"), (3, "p")]
    assert rows(access.among(files_, "file_id", [1, 4]), "file_id") == [(1,), (4,)]
    assert rows(access.among(files_, "file_id", members.select("user").limit(0).union(members.select(F.lit(2))).distinct()), "file_id") == [(2,)]
    ends = spark.createDataFrame([(1, datetime.datetime(2024, 1, 2)), (2, datetime.datetime(2024, 1, 1)), (3, None)], "i int, until timestamp")
    assert rows(access.not_expired(ends, "until", F.to_timestamp(F.lit("2024-01-01 00:00:00"))), "i") == [(1,), (3,)]
    versions = spark.createDataFrame([(1, 10), (1, 11), (9, 12)], "file_id int, version int")
    assert rows(access.project_of(versions, files_), "file_id", "version", "project_id") == [(1, 10, "p"), (1, 11, "p")]
    owned = {r.file_id: [tuple(p) for p in r.parts] for r in access.with_parts(files_.select("file_id"), versions.withColumn("n", -F.col("version")), "file_id", ["n"]).collect()}
    assert owned == {1: [(-11, 11), (-10, 10)], 2: [], 3: [], 4: []}


def test_helper_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, rank int, rank_ string")
    assert rows(windows.first_of(df, ["k"], [F.desc("rank")])) == [(1, 2, "b"), (2, 1, "c")]
    runs = spark.createDataFrame([(1, 5, 1, "x", 9), (1, 6, 1, "y", 8), (1, None, 2, "z", 7)], "f int, done int, upd int, _r string, t int")
    assert rows(access.latest_completed(runs, "f", "done", "upd", "t")) == [(1, 6, 1, "y", 8)]


def test_evidence_and_claims(spark):
    sources = spark.createDataFrame([("c", 1, "a", 0), ("c", 1, "a", 1), ("c", 2, "a", 2), ("c", 3, "b", 3), ("d", 1, "a", 4)], "claim string, file_version_id int, source_document string, pos int")
    assert rows(evidence.references(sources, "claim", ["pos"], 2), "claim", "pos", "n") == [("c", 0, 0), ("c", 2, 1), ("d", 4, 0)]
    held = spark.createDataFrame([("k1", "p", 1, "t1"), ("k1", "q", 1, "t2")], "chunk_id string, project_id string, version_id int, text string")
    cited = spark.createDataFrame([("k1", "p", 1, "x"), ("k1", "p", 2, "y"), ("k2", "p", 1, "z")], "chunk_id string, project_id string, version_id int, claim string")
    assert rows(evidence.claim_chunks(cited, held), "claim", "text") == [("x", "t1")]
    said = spark.createDataFrame([(1, "a", [3, 1, 9], " Some-Kind ", "Field  Name", " v  w ", 1.5, " e "), (1, "b", [9], None, None, None, None, None)], "batch int, claim_id string, chunk_indexes array<int>, category string, field_name string, original_value string, confidence double, supporting_excerpt string")
    got = evidence.batch_claims(said, spark.createDataFrame([(1, 1), (1, 3), (2, 9)], "batch int, chunk_index int"), ["batch"]).collect()
    assert [(r.claim_id, r.chunk_indexes, r.category, r.field_name, r.original_value, r.confidence, r.supporting_excerpt) for r in got] == [("a", [3, 1], "some_kind", "field_name", "v w", 1.0, "e")]
    facts = spark.createDataFrame([("a", "x", 0.9, [("y", 0.5)]), ("b", "x", 0.9, []), ("c", "x", 0.9, [("y", 0.5)])], "field string, value string, score double, alternatives array<struct<value:string,score:double>>")
    assert rows(claims.conflicts(facts, "field", ["a", "b"]), "field", "selected_value") == [("a", "x")]


def test_facts_by_scope(spark):
    facts = [(1, i, "zz", f"v{i}") for i in range(90)] + [(1, 100, "owner", "canon"), (1, 101, "zz", "V0"), (2, 102, "zz", "v0")] + [(1, 200 + i, "works_phase", f"p{i}") for i in range(70)]
    got = extraction.scoped_facts(spark.createDataFrame(facts, "doc int, n int, field string, value string"), ["owner"], ["doc"], ["n"])
    assert {(r.scope, r.c) for r in got.groupBy("scope").agg(F.count(F.lit(1)).alias("c")).collect()} == {("supporting_facts", 80), ("work_stages", 60)}
    assert got.where("n in (100, 101)").count() == 0


def test_lines_and_documents(spark):
    lines = spark.createDataFrame([(1, 0, "x"), (1, 1, "Faza e pare"), (1, 2, "12.05.2020"), (2, 0, "a"), (2, 1, "b"), (2, 2, "c")], "d int, line_no int, line string").withColumn("hit", F.lit("mine"))
    assert rows(chunks.schedule_lines(lines, "d", ["faza"], most=5, fallback=2), "d", "line_no", "hit") == [(1, 1, "mine"), (1, 2, "mine"), (2, 0, "mine"), (2, 1, "mine")]
    docs = spark.createDataFrame([(1, "ok\nvalue ____ here\nTODO  it\nx"), (2, "fine"), (3, None)], "d int, text string")
    assert rows(verification.placeholder_lines(docs, "text", 1), "d", "lines") == [(1, ["value ____ here"])]
    found = spark.createDataFrame([("s", "parsed", "b"), ("s", "parsed", "a"), ("s", "failed", "c")], "src string, status string, name string")
    (r,) = summaries.parse_summary(found, spark.createDataFrame([("s", 5)], "src string, n int"), "src", "status", "name").collect()
    assert (r.names, r.missing) == ({"failed": ["c"], "parsed": ["a", "b"]}, 2)
    inv = spark.createDataFrame([("p", "parsed", "unknown"), ("p", "failed", "unknown"), ("p", "parsed", "letter")], "p string, status string, kind string")
    assert rows(summaries.inventory(inv, ["p"], F.col("status") == "parsed", "kind")) == [("p", 3, 2, 1, 2)]


def test_rules_versions_search(spark):
    one = spark.range(1)
    meets = lambda groups, has: one.select(audit.meets_groups(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.array(*map(F.lit, has))).alias("m")).first().m
    assert meets([["a", "b"], ["c"]], ["b", "c"]) and not meets([["a"], ["c"]], ["c"])
    versions = spark.createDataFrame([(1, 1, None), (1, 2, None), (2, 1, None), (2, 2, "gone")], "f int, version_number int, deleted_at string")
    assert rows(sync.current_versions(versions, "f"), "f", "version_number") == [(1, 2)]
    ev = spark.createDataFrame([("a", "chunk", "leja e ndertimit", 1.0), ("b", "chunk", "tjeter", 1.0), ("c", "claim", "leja", 1.0), ("d", "chunk", "leja", 1.0)], "id string, kind string, text string, authority double")
    assert rows(retrieval.fulltext_boost(ev, ["leja"], most=1), "id", "authority") == [("a", 5.0), ("b", 1.0), ("c", 1.0), ("d", 1.0)]
    assert rows(files.renamed(spark.createDataFrame([("a/b.gdoc",), ("c",)], "path string"), ".pdf")) == [("a/b.pdf",), ("c.pdf",)]


def test_text_functions(spark):
    one = lambda *cs: tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cs)]).first())
    lit = F.lit
    assert one(t.day_or_last(lit("5.6.2020")), t.day_or_last(lit("x"))) == (datetime.date(2020, 6, 5), datetime.date(9999, 12, 31))
    assert one(t.query_tokens(lit("Kur ka filluar puna, kur?"), ["kur", "puna"])) == (["filluar"],)
    same = [("Nr. 12/3 prot", "nr 3 date 12", True), ("Vila Alfa", "vila alfa nord", True), ("12", "12 13", False), ("", "", False), ("Leje nr 5", "Leje nr 6", False)]
    assert one(*[t.same_numbers_or_tokens(lit(a), lit(b)) for a, b, _ in same]) == tuple(w for *_, w in same)
    assert one(F.unix_timestamp(labels.instant(lit("2024-01-01T00:00:10Z"))), labels.instant(lit("soon"))) == (1704067210, None)
