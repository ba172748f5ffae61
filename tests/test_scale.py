"""What plans must not do at size: rows written out before they meet, keys of few values shuffled; and inputs beyond the small tables."""

import re

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliate.operators import chunks, drafts, extraction

SF = "/root/testdata/sf0.001"


def executed(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_section_plan_writes_sections_out_last(spark):
    plan = executed(entry.queries()["section_plan"](spark, SF))
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Exchange") and "Join" not in plan[: plan.index("Generate")]


def test_keyword_facts_has_the_word_edges_of_its_sql(spark, tmp_path):
    texts = ["und ciónrrco la", "und NUMËR 7", "und é1.2.2020", "und xnr 7", "und nr. 5/A", "und 1.2.20201", "und _nr 7", "und cinrrco"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.sql(entry.oracle_sql()["keyword_facts"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in entry.queries()["keyword_facts"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {i for i, *_ in got} == {0, 1, 2, 4}


@pytest.mark.parametrize("name", ["domain_conflicts", "project_relation"])
def test_rows_are_not_shuffled_by_a_field_of_few_values(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the rows are too many
    try:
        plan = executed(entry.queries()[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(field#\d+, \d+\)", plan)


def test_texts_of_drafts_are_not_written_out_by_word(spark):
    values = spark.createDataFrame([(1, 0, "Nr. 12/2020"), (1, 1, "ndertes kulla blu"), (1, 2, "kulla gjelbe"), (1, 3, "ab"), (1, 4, "zz"), (2, 0, "kulla")], "draft_id long, n int, value string")
    shown = spark.createDataFrame([(1, "Ndërtesa: Kulla, blu. AB 2020, 12"), (2, None)], "draft_id long, text string")
    got = drafts.present(values, shown, ["n"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0), (1, 1), (1, 3)]
    assert "Generate" not in executed(got)


def test_facts_of_lines_come_from_one_pass_and_lose_none(spark):
    plan = executed(entry.queries()["extracted_facts"](spark, SF))
    assert plan.count("FileScan parquet") <= 2
    texts = [
        "EMëRTIMI I OBJEKTIT: Kulla", "Për objektin - Shkolla", "VENDNDODHJA e objektit: Rruga", "ADRESA: Tirana", "Investitor: A b", "ZHVILLUESI: C d", "porositësi: E f", "Sipërmarrësi: G h", "Subjekti  ndërtues: I j",
        "MBIKëQYRëSI i punimeve: K l", "Supervizori: M n", "KOLAUDATORI: O p", "Studio projektuese: Q r", "Leje ndërtimi nr. 5/A, VENDIM nr. 7, 12/3 Prot., 1.2.2020", "Leja e zhvillimit, vendim 8", "Vlera sipas situacionit 12.500 lekë",
        "Sipërfaqja e truallit që ZHVILLOHET 100,5 m2", "Siperfaqja e zënë nga STRUKTURA 40 m2", "SIPERFAQJA e përgjithshme e ndërtimit 300", "Lartësia MAKSIMALE 12,5 m", "Numri i kateve mbi NIVELIN e tokës 5", "numri i kateve nën nivelin e tokës 2",
        "Ngarkesa e lejuar 2,5 kg/cm2", "SIZMICITET 7 ballë", "PASURIA me nr. 5/2", "Nr. pasurisë: 9/1", "ZONA kadastrale nr. 8", "NR.Z.K.: 77", "FSHATI Ar, Bashkia Be", "LAGJJA xy, Bashkia Be", "Zbatues, NIPT K12345678L", "lic. NZ.1234/5", "Fillimi i punimeve 1.2.2020", "\u00a0 \t", "", None,
    ]
    lines = spark.createDataFrame([(d, i, x) for d in (1, 2) for i, x in enumerate(texts)], "d int, line_no int, line string")
    columns = ["d", "line_no", "n", "field", "value", "evidence", "extraction"]
    parts = [extraction.line_facts(lines), extraction.role_facts(lines, ["d"]), extraction.metric_facts(lines, "line"), extraction.places(lines, "line")]
    want = [(step, *r) for step, x in zip((0, 2, 3, 4), parts, strict=True) for r in x.select(columns).collect()]
    got = [tuple(r) for r in extraction.stated(lines, ["d"], whole=True).select("step", *columns).collect()]
    assert sorted(got) == sorted(want)
    fields = {(r[2], r[4]) for r in got if r[1] == 1}
    assert {i for i, _ in fields} == set(range(len(texts))) - {31, 33, 34, 35}
    assert {(13, "construction_permit_number"), (13, "construction_permit_protocol"), (13, "construction_permit_date"), (30, "contractor_license"), (30, "contractor_nipt")} <= fields


def test_words_are_boxed_without_a_shuffle_of_words(spark, tmp_path):
    plan = executed(entry.queries()["ocr_line_boxes"](spark, SF))
    assert plan.count("Generate") == 1  # lines, not words
    rows = [(1, 20, 5, 10, 12, 40, "b", 1), (1, 0, 6, 10, 12, 90, "aaa", 0), (1, 0, 6, 10, 12, 29, "low", 2), (1, 0, 6, 10, 12, None, "none", 3), (1, 20, 5, 30, 9, 31, "c", 0), (2, 0, 0, 1, 1, 99, "  ", 0), (2, 0, 0, 1, 1, 99, None, 1)]
    words = spark.createDataFrame(rows, "k int, left int, top int, width int, height int, conf int, text string, word_num int")
    held = words.groupBy("k").agg(F.collect_list(F.struct(*words.columns[1:])).alias("w")).select("k", chunks.line_of(F.col("w"), 30).alias("b")).where("b is not null").select("k", "b.*")
    assert [tuple(r) for r in held.collect()] == [tuple(r) for r in chunks.ocr_lines(words, ["k"], 30).collect()] == [(1, 0, 5, 50, 18, 68.2, 3, "aaa c b")]
    texts = [(1, "one  two\n\n  \nthree"), (1, "uno dos"), (2, None), (3, ""), (4, " x y z" * 20)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.sql(entry.oracle_sql()["ocr_line_boxes"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in entry.queries()["ocr_line_boxes"](spark, str(tmp_path)).collect()]
    assert sorted(r[:8] for r in got) == sorted(r[:8] for r in want) and {r[8] for r in got if r[0] != 1} == {r[8] for r in want if r[0] != 1}
