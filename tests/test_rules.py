"""Rules of fields, values, labels and checks: literal cases, worked out from the rules by hand."""

import datetime

from pyspark.sql import functions as F

from foliate.functions import fields, labels
from foliate.functions import text as t
from foliate.operators import claims, evidence, extraction, retrieval, summaries, verification
from foliate.operators.chunks import clean_lines, placed_chunks, relevant_excerpt


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


L = F.lit


def test_money(spark):
    said = {"1.234.567": 1234567.0, "1.234,56": 1234.56, "1,234.56": 1234.56, "1,234": 1234.0, "1.234": 1234.0, "12,5": 12.5, "1,23,45": None, "12 lekë": 12.0, "": None, "-5.5": -5.5, "1,2,3.4": 123.4}
    assert one(spark, *[t.money(L(s)) for s in said]) == tuple(said.values())


def test_days(spark):
    said = {"1/2/2020": (2020, 2, 1), "1-2-2020": (2020, 2, 1), "31.12.1999": (1999, 12, 31), "2020-1-5": (2020, 1, 5), "signed 31/12/2020": (2020, 12, 31), "30.02.2020": None, "1/2-2020": None, "none": None}
    assert one(spark, *[t.day(L(s)) for s in said]) == tuple(v and datetime.date(*v) for v in said.values())
    assert one(spark, t.days(L("111.6.2020 1.1.1820 5.5.21, 40.1.2020 7-8/2020")))[0] == ["05.05.2021", "07.08.2020"]


def test_value_equivalences(spark):
    same = lambda f, a, b: one(spark, f(L(a), L(b)))[0]
    assert same(t.same_numbers_or_tokens, "Nr. 12 prot 5", "5/12") and not same(t.same_numbers_or_tokens, "", "") and same(t.same_numbers_or_tokens, "Alba Ndertim nr 3", "ALBA ndërtim shpk 4")
    assert same(t.token_subset, "Alba sh.p.k", "ALBA shpk") and same(t.token_subset, "12 port", "12 prot nr") and not same(t.token_subset, "", "x") and not same(t.token_subset, "a b", "a c")
    assert same(t.inside_or_numbers, "A B", "xabx") and not same(t.inside_or_numbers, "abc", "") and same(t.inside_or_numbers, "1 of 2", "2-1-3") and same(t.inside_or_numbers, "a1b2", "none")
    assert not same(t.value_in_text, "5 zebras", "floor 5 of tower") and same(t.value_in_text, "leje 12/2020", "x 2020 y 12") and same(t.value_in_text, "Blue Green Red Sky", "sky red blue") and not same(t.value_in_text, "leje", "x")


def test_secrets(spark):
    key = "sk-" + "a" * 20
    assert one(spark, t.redacted(L(f"use {key} now")), t.has_secret(L("token = " + "x" * 20)), t.has_secret(L("a@b.org")), t.has_secret(L("token"))) == ("use [REDACTED_SECRET] now", True, False, False)


def test_fields(spark):
    assert one(spark, *[fields.canonical_field(L(x)) for x in ("Emri i Objektit", "Permit-Number", "Mbikëqyresi", "other field", None)]) == ("object_name", "construction_permit_number", "supervisor", "other_field", "")
    assert one(spark, fields.contextual_field(L("permit date"), L("Leje  Zhvillimi"), L("x")), fields.contextual_field(L("permit_date"), L("y"), L(None).cast("string"))) == ("development_permit_date", "construction_permit_date")
    assert one(spark, fields.registers(L("work_phase"), L("works")), fields.registers(L("other"), L("completion_date")), fields.registers(L("x"), L("y"))) == (["technical_works", "construction_chronology"], ["construction_chronology"], ["supporting_evidence"])
    ok = lambda *x: one(spark, fields.admissible(*[L(v).cast("string") for v in x]))[0]
    number = "construction_permit_number"
    assert not ok(number, "permit", "Nr. 5", "leje ndertimi", "supervisor_contract") and ok(number, "permit", "5", "leje ndertimi", "construction_permit") and not ok(number, "x", "Nr. 55", "leje ndertimi", "letter")
    assert ok(number, "x", "Nr. 55", "leje ndertimi prot 7", "letter") and not ok(number, "x", "abc", "", "letter") and ok("planned_value", "x", "5", "", "letter") and not ok("owner", "property", "x", "", "contractor_contract")
    assert one(spark, fields.fact_value(L("start_date"), L("më 1/2/2020")), fields.fact_value(L("owner"), L("Z. Ark. Dritan, SHPK Nr 5"))) == ("01.02.2020", "dritan 5")
    clean = lambda f, v: one(spark, fields.clean_value(L(f), L(v)))[0]
    assert clean("contractor", ' "ALBA" shpk, me NIPT K1') == 'ALBA" shpk' and clean("object_name", "Emri i objektit: Vila 1, me adresë X") == "Vila 1" and clean("owner", "a | b") == "a" and clean("owner", "___") is None and clean("designer", "realizuar sipas planit") is None


def test_labels(spark):
    assert one(spark, labels.party_name(L("ing.Alba_ndertim kontrate x.docx")), labels.party_name(L("ab")), labels.licence_number(L("nz 12.5")), labels.money_text(L("1234567 all")), labels.money_text(L("none"))) == ("ing. Alba ndertim", None, "NZ12-5", "1.234.567", "none")
    day = F.to_timestamp(L("2024-06-30 22:30:00"))
    assert one(spark, labels.local_date(day), labels.local_date(F.to_timestamp(L("2024-01-30 22:30:00"))), labels.local_date(L(None).cast("timestamp"))) == ("01.07.2024", "30.01.2024", "")
    assert one(spark, labels.with_units(L("12,5 m2 and 3,5m² (x) 7 kg/cm2")), labels.with_units(L("100,5 (20,5 m2 podrum)")), labels.with_places(L("Vlore, Tirane"))) == ("12.5 m² and 3.5 m² (x) 7 kg/cm²", "100.5 m², nga të cilat 20.5 m² podrum", "Vlorë, Tiranë")
    assert one(spark, *[labels.mass_text(L(x)) for x in ("5112", "12,5", "1234.5678", "x")]) == ("5,112 kg", "12.5 kg", "1,234.568 kg", "x kg")
    hosts = ("drive.google.com",)
    link = "https://drive.google.com/"
    assert one(spark, *[labels.folder_id(L(x), hosts) for x in ("abcdefghij12", link + "drive/u/0/folders/abcdefghij12?x=1", link + "open?id=abcdefghij12", "https://evil.com/folders/abcdefghij12", "short")]) == ("abcdefghij12",) * 3 + (None, None)
    assert one(spark, labels.replaced_value(L("12 of 112 and 12"), L("12"), L("$5")), labels.replaced_value(L("abc"), L("b"), L("")), labels.safe_component(L(" a/b ")), labels.safe_component(L(".."))) == ("$5 of 112 and $5", "abc", "a_b", "dokument")
    objects = ['```json\n{"a": 1}\n```', 'so {"a": "}{", "b": {"c": 2}} end }', "{ never", "none", '{"q": "\\""}']
    assert one(spark, *[labels.json_object(L(x)) for x in objects]) == ('{"a": 1}', '{"a": "}{", "b": {"c": 2}}', None, None, '{"q": "\\""}')
    pair = lambda **kv: F.create_map(*[L(x) for p in kv.items() for x in p])
    assert one(spark, labels.merged(pair(a="1", b="2"), pair(b="3"))) == ({"a": "1", "b": "3"},)


def test_extraction(spark):
    lines = spark.createDataFrame([(0, "Zbatuesi: ALBA shpk"), (1, "lic. NZ. 1234/5, NIPT K12345678L"), (2, "Leje zhvillimi, vendim nr. 7 dt 5.5.2020"), (3, "Vlera e situacionit 12.500 lekë"), (4, "Përfundimi i punimeve 1.2.21")], "line_no int, line string").withColumn("d", L(1))
    facts = lambda df: {(r.field, r.value) for r in df.collect()}
    assert facts(extraction.labelled_facts(lines)) == {("contractor", "ALBA shpk")} and facts(extraction.role_facts(lines, ["d"])) == {("contractor_license", "NZ-1234/5"), ("contractor_nipt", "K12345678L")}
    assert facts(extraction.permit_facts(lines)) == {("development_permit_number", "Nr. 7"), ("development_permit_date", "05.05.2020")} and facts(extraction.amount_facts(lines)) == {("final_value", "12.500 lekë")} and facts(extraction.timeline_facts(lines)) == {("completion_date", "01.02.2021")}
    got = extraction.keyword_facts(lines.where("line_no in (2, 4)"))
    assert {(r.line_no, r.category) for r in got.collect()} == {(2, "permit"), (2, "formal_references"), (4, "timeline"), (4, "formal_references")}
    assert one(spark, extraction.after_separator(L("a: bcd")), extraction.after_separator(L("a: b - long")), extraction.after_separator(L("plain"))) == ("bcd", "b - long", "plain")


def test_questions(spark):
    assert retrieval.intents("Kur kanë filluar punimet? Çfarë mungon sipas VKM?") == {"chronology", "missing", "law"} and retrieval.preferred_sections("Kush është investitori?") == ["parties_and_contracts"]
    rows = [("1", "law", "neni 5 ligji", 7.0, None, None), ("2", "chunk", "teksti", 1.0, "start_date", None), ("3", "dossier", "x", 10.0, "missing_core_fields", None), ("4", "claim", "asgje", 5.0, "owner", None)]
    df = spark.createDataFrame(rows, "id string, kind string, text string, authority double, field_name string, chunk_id string")
    got = [(r.id, r.score) for r in retrieval.ranked(df, "data e fillimit", ["data", "fillimit"]).collect()]
    # 2: 1 + .5 + 2 tokens in its words + 5 for the field + 9 for a date; the others match nothing
    assert got == [("2", 1 + 0.5 + 4 + 5 + 9 + 5)]


def test_checks_of_texts(spark):
    numbers = "1 2 3 4 5 6"
    assert one(spark, evidence.numbers_alone(L(numbers)), evidence.numbers_alone(L(numbers + " cm")), evidence.numbers_alone(L("1 2 3"))) == (True, False, False)
    assert one(spark, evidence.fused(L("1234567 and so on and so on and on")), evidence.fused(L("12 cm, 5 kg, 7 mm and more words")), evidence.fused(L("short")), evidence.boilerplate(L("Këto nuk përbëjnë prova laboratorike"))) == (True, False, False, True)
    assert one(spark, evidence.excerpt_verified(L(""), L("x")), evidence.excerpt_verified(L("A  b"), L("xa B")), evidence.excerpt_verified(L("c"), L("ab"))) == (True, True, False)
    assert one(spark, claims.corroboration(L(0.8), L(0.0), L(0.0), L(0)), claims.corroboration(L(1.0), L(1.0), L(1.0), L(9))) == (0.57 * 0.8, 0.99)


def test_lines_and_chunks(spark):
    df = spark.createDataFrame([(1, "Привет мир\nab\nROOT ENTRY\n12\n1234\nпривет МИР")], "id int, body string")
    assert [r.line for r in clean_lines(df, "id", "body").orderBy("line_no").collect()] == ["Привет мир", "1234"]
    blocks = spark.createDataFrame([(1, k, x) for k, x in enumerate(["aaaa", " ", "bbb", "c" * 25, "dd"])], "id int, at int, body string")
    got = placed_chunks(blocks, ["id"], "at", "body", limit=10).orderBy("chunk_index").collect()
    assert [(r.start, r.end, r.chunk) for r in got] == [(0, 2, "aaaa\n\nbbb"), (3, 3, "c" * 10), (3, 3, "c" * 10), (3, 4, "ccccc\n\ndd")]
    text = "\n".join([f"plain line {k}" for k in range(10)] + ["the permit is here", "The PERMIT is here"])
    assert one(spark, relevant_excerpt(L(text), ["permit"], 1000))[0].split("\n") == [f"plain line {k}" for k in range(8)] + ["the permit is here"]


def test_shape_findings_and_summary(spark):
    drafts = spark.createDataFrame([(1, "sum"), (2, " ")], "draft_id int, summary string")
    sections = spark.createDataFrame([(1, f"s{k % 10}", "t", "body" if k else "") for k in range(11)] + [(2, "a", "x ____", "checklist")], "draft_id int, code string, title string, body string")
    found = verification.shape_issues(sections, drafts).collect()
    assert sorted((r.draft_id, r.code) for r in found) == [(1, "PUBLIC-SECTION-DUPLICATE"), (1, "PUBLIC-SECTION-EMPTY"), (2, "PUBLIC-INTERNAL-TERMS"), (2, "PUBLIC-PLACEHOLDER"), (2, "PUBLIC-STRUCTURE-INVALID"), (2, "PUBLIC-SUMMARY-MISSING")]
    findings = spark.createDataFrame([(1, {"a": "b"}), (2, {}), (3, None)], "id int, evidence map<string,string>")
    assert [r.id for r in verification.verified_findings(findings).collect()] == [1]
    issues = spark.createDataFrame([("A", "major", 1), ("B", "minor", 2), ("C", "major", 1)], "code string, severity string, claim_id int")
    assert tuple(verification.summary(issues).first()) == (3, 2, 1, False)


def test_details_conflicts_and_integrity(spark):
    rows = [(1, str(k), "permits_property_licenses", f, v, "high", ["leje.pdf"]) for k, (f, v) in enumerate([("permit number", "12"), ("property number", "Pasuria 5/6"), ("property number", "pasuria 5/6 x"), ("owner", "me"), ("start date", "1.1.2020")])]
    got = summaries.required_details(spark.createDataFrame(rows, "d int, evidence_id string, register string, field_name string, value string, confidence_level string, sources array<string>"), spark.createDataFrame([], "d int, field string, value string"), "d")
    assert [(r.field_name, r.value, r.must_include) for r in got.orderBy("n").collect()] == [("construction_permit_number", "12", True), ("start_date", "1.1.2020", True), ("property_number", "pasuria 5/6 x", True)]
    facts = spark.createDataFrame([("start_date", "2.1.2021"), ("completion_date", "1.1.2021")], "field string, value string")
    assert [(r.code, r.detail) for r in claims.integrity(facts, 3, 1).orderBy("code").collect()] == [("DOSSIER-ANALYSIS-COVERAGE", "2"), ("DOSSIER-CHRONOLOGY-ORDER", "02.01.2021 > 01.01.2021")]
