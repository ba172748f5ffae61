"""Trees, closures, packets, drafts and sections against plain versions and literal cases."""

import datetime
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliate.functions import fields, labels
from foliate.functions import text as t
from foliate.operators import audit, chunks, claims, dossier, drafts, evidence, extraction, packets, reports, summaries, tree, verification

ITEM = "id string, parent_id string, name string, is_folder boolean, is_output boolean, size int"


def listing(spark, rows, **more):
    return sorted(tuple(r) for r in tree.folder_tree(spark.createDataFrame(rows, ITEM), "r", **more).collect())


def test_folder_tree(spark):
    rows = [
        ("r", None, "Root", True, None, 0), ("a", "r", "A/1", True, False, 0), ("b", "a", "..", True, None, 0), ("f", "r", "f.pdf", False, None, 1), ("g", "a", "g.pdf", None, None, 2), ("h", "b", None, False, None, 3),
        ("o", "r", "out", True, True, 0), ("i", "o", "i.pdf", False, None, 4), ("p", "o", "deep", True, None, 0), ("j", "p", "j.pdf", False, None, 5), ("k", "r", "report.pdf", False, True, 6),
        ("x", "y", "X", True, None, 0), ("y", "x", "Y", True, None, 0), ("l", "x", "l.pdf", False, None, 7), ("m", None, "m.pdf", False, None, 8), (None, "r", "n.pdf", False, None, 9), ("q", "gone", "q.pdf", False, None, 1),
    ]
    want = [("f", "Root/f.pdf", 0, 1), ("g", "Root/A_1/g.pdf", 1, 2), ("h", "Root/A_1/dokument/dokument", 2, 3)]
    assert listing(spark, rows) == want
    assert listing(spark, rows, most=3) == want
    with pytest.raises(ValueError, match="2 files"):
        listing(spark, rows, most=2)
    assert listing(spark, []) == []


@pytest.mark.parametrize(("depth", "fits"), [(20, True), (21, False), (45, False)])
def test_folder_tree_depth(spark, depth, fits):
    rows = [("r", None, "r", True, None, 0), *[(f"d{i}", f"d{i - 1}" if i > 1 else "r", f"{i}", True, None, 0) for i in range(1, depth + 1)], ("f", f"d{depth}", "f", False, None, 1)]
    if fits:
        assert listing(spark, rows) == [("f", "/".join(["r", *map(str, range(1, depth + 1)), "f"]), depth, 1)]
    else:
        with pytest.raises(ValueError, match="20 levels"):
            listing(spark, rows)


def test_folder_tree_with_a_cycle_below_the_root(spark):
    rows = [("r", None, "r", True, None, 0), ("a", "r", "a", True, None, 0), ("b", "a", "b", True, None, 0), ("a", "b", "a", True, None, 0)]
    with pytest.raises(ValueError, match="20 levels"):
        listing(spark, rows)


def test_closure_of_support(spark):
    items = [(f"e{i}", "end" if i == 10 else None) for i in range(11)] + [("c1", "one"), ("c2", "two"), ("c3", None)]
    support = [(f"e{i}", f"e{i + 1}") for i in range(10)] + [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("gone", "e10"), ("c3", None)]
    cited = [(1, "e0"), (1, "e0"), (2, "c3"), (3, "gone"), (4, "e10"), (5, None)]
    got = evidence.supported_registers(spark.createDataFrame(cited, "claim_id int, evidence_id string"), spark.createDataFrame(items, "evidence_id string, register string"), spark.createDataFrame(support, "evidence_id string, supporting string"))
    assert sorted(map(tuple, got.collect())) == [(1, "end"), (2, "one"), (2, "two"), (4, "end")]


def test_cleaned_values_are_a_small_plan(spark):
    df = spark.createDataFrame([("designer", ' "Studio X, me Lic. 12"'), ("designer", "realizuar sipas " + "x" * 9), ("object_name", "Emri i objektit: Vila, në Fshat A"), ("other", "a | b"), ("location", None), ("location", "..... ")], "field string, value string")
    got = df.select(fields.clean_value(F.col("field"), F.col("value")).alias("v"))
    assert [r.v for r in got.collect()] == ["Studio X", None, "Vila", "a", None, None]
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000


# --- packets


def plain_shrink(budget, fixed, entries, floors, steps):
    left = [dict(e, sources=list(e["sources"])) for e in entries]

    def tokens():
        return max(1, (fixed + sum(e["size"] + sum(e["sources"]) for e in left)) // 3)

    for _ in range(steps):
        if tokens() <= budget:
            break
        lists = [e for e in left if len(e["sources"]) > 1]
        if lists:
            max(lists, key=lambda e: len(e["sources"]))["sources"].pop()
            continue
        n = Counter(e["register"] for e in left if e["removable"])
        may = [e for e in left if e["removable"] and n[e["register"]] > floors.get(e["register"], 1)]
        if not may:
            break
        left.remove(min(may, key=lambda e: (e["confidence"] or 0, e["corroboration"] or 0)))
    return [(e["place"], e["sources"]) for e in left]


@pytest.mark.parametrize("steps", [7, 300])
def test_shrinking_against_the_plain_loop(spark, steps):
    r = random.Random(steps)
    heads, rows, want = [], [], []
    for p in range(40):
        entries = []
        for i in range(r.randint(0, 25)):
            entries.append({"place": i, "register": r.choice("abcd"), "removable": r.random() < 0.8, "confidence": r.choice([None, 0.1, 0.5, 0.9]), "corroboration": r.choice([None, 1, 2]), "size": r.randint(1, 90), "sources": [r.randint(1, 60) for _ in range(r.randint(0, 6))]})
        whole = sum(e["size"] + sum(e["sources"]) for e in entries)
        heads.append((p, r.randint(0, max(1, whole // 3)), r.randint(0, 30)))
        rows += [(p, *e.values()) for e in entries]
        want += [(p, *x) for x in plain_shrink(heads[-1][1], heads[-1][2], entries, {"a": 3, "b": 0, "c": 1}, steps)]
    got = packets.shrunk(spark.createDataFrame(heads, "packet int, budget int, fixed int"), spark.createDataFrame(rows, "packet int, place int, register string, removable boolean, confidence double, corroboration int, size int, sources array<int>"), ["packet"], {"a": 3, "b": 0, "c": 1}, steps)
    assert sorted((x.packet, x.place, x.sources) for x in got.collect()) == sorted(want)


def test_packets_and_statements(spark):
    entries = [(1, "stakeholders", i, "investor" if i else "numeric_values", f"v{i}", None) for i in range(30)] + [(1, "technical_works", 0, "slab", "ok", None)]
    got = packets.packet_entries(spark.createDataFrame(entries, "p int, register string, n int, field string, value string, normalized string"), ["p"])
    assert sorted(r.n for r in got.where("register = 'stakeholders'").collect()) == list(range(1, 25))  # noise is left out, then 24 stay
    concerns = spark.createDataFrame([(1, "conflict:0", "canonical_conflict", "slab", None), (1, "conflict:1", "canonical_conflict", "none", None), (1, "integrity:0", "integrity_issue", None, "DOSSIER-CHRONOLOGY-ORDER"), (1, "integrity:1", "integrity_issue", None, "X")], "p int, evidence_id string, kind string, field string, code string")
    may = packets.domain_evidence(got, concerns, ["p"])
    of = lambda e: sorted(r.domain for r in may.where(F.col("evidence_id") == e).collect())
    assert of("conflict:0") == ["materials_quality", "structural_hidden_works"]
    assert of("conflict:1") == of("integrity:1") == sorted(packets.DOMAINS)
    assert of("integrity:0") == ["chronology_completion"]
    assert of("stakeholders:3") == ["contractual_economic", "legal_administrative"]
    said = [(1, "legal_administrative", "facts", 0, " a  b ", ["x", "stakeholders:2", "stakeholders:1", "stakeholders:2"]), (1, "legal_administrative", "facts", 1, "", ["stakeholders:1"]), (1, "legal_administrative", "facts", 2, "c", ["technical_works:0"]), (1, "legal_administrative", "facts", 9, "late", ["stakeholders:1"]), (1, "materials_quality", "facts", 0, "d", None)]
    said += [(1, "legal_administrative", "facts", n, "z", []) for n in (3, 4)]
    kept = packets.allowed_statements(spark.createDataFrame(said, "p int, domain string, kind string, n int, statement string, evidence_ids array<string>"), may, ["p"])
    assert [tuple(r) for r in kept.select("n", "statement", "evidence_ids").collect()] == [(0, "a b", ["stakeholders:2", "stakeholders:1"])]
    memo = {r.domain: (r.status, r.evidence_count, r.statements) for r in packets.memoranda(spark.createDataFrame([(1,)], "p int"), may, kept, ["p"]).collect()}
    assert memo["legal_administrative"] == ("reviewed", 26, 1)
    assert memo["materials_quality"][0] == "no_supported_statements"


# --- drafts


def test_values_present_as_one_by_one(spark):
    r = random.Random(4)
    words = ["vila", "Fshati", "nr", "12", "345", "a12", "bashkia", "çati", "mur", "murature", "x", "7", "tulla", "beton"]
    texts = [(d, " ".join(r.choices(words, k=r.randint(0, 30))) if d else None) for d in range(12)]
    values = [(d, n, r.choice([None, "", "nr", "12", "345 12", "tull", "mur beton", *[" ".join(r.choices(words, k=r.randint(1, 5))) for _ in range(4)]])) for d in range(13) for n in range(30)]
    shown, asked = spark.createDataFrame(texts, "draft_id int, text string"), spark.createDataFrame(values, "draft_id int, n int, value string")
    want = asked.join(shown, "draft_id").where(t.value_in_text(F.col("value"), F.coalesce("text", F.lit("")))).select("draft_id", "n")
    got = drafts.present(asked, shown, ["n"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


DRAFT = f"draft_id int, title string, summary string, signature string, sections array<{drafts.SECTION}>, ledger array<{drafts.CLAIM}>"


def claim(n, said, section="s0", level="proven", kind="documented_fact", ids=("e",)):
    return (f"c{n}", section, said, kind, level, list(ids), 0.5)


def a_draft(d=1, bodies=None, ledger=None, summary="Vila Alfa", signature=None):
    return (d, "Akt", summary, signature, [(f"s{i}", f"T{i}", b) for i, b in enumerate(bodies or [])], ledger)


def settled(df):
    """The frame's rows without what made them, as between the steps of a review."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def one(df):
    r = df.collect()[0]
    return r.summary, [(s.code, s.title, s.body) for s in r.sections], [(c.claim_id, c.section_code, c.statement, c.evidence_ids) for c in r.ledger]


FACTS = "draft_id int, field string, value string"
CONFLICT = "draft_id int, n int, field string, selected string, alternatives array<string>, sources array<string>, other_sources array<string>"
DETAIL = "draft_id int, n int, field string, register string, value string, evidence_id string, must_include boolean, sources array<string>"


def test_draft_issues_and_their_correction(spark):
    quantity = "Nga 1 2 3 4 5 6"
    ledger = [claim(0, "Ndertuesi Beta sh.p.k."), claim(1, quantity), claim(2, "Ndërtesa")]
    d = spark.createDataFrame([a_draft(1, ["Ndertuesi Beta sh.p.k.", f"Ndërtesa\n\n{quantity}\n\nFund"], ledger), a_draft(2, ["x"], [])], DRAFT)
    facts = spark.createDataFrame([(1, "investor", "Gama Ndertim"), (1, "object_name", "Vila Alfa"), (1, "contractor", "Delta Invest"), (1, "other", "zz"), (2, "location", " "), (3, "owner", "none")], FACTS)
    conflicts = spark.createDataFrame([(1, 0, "contractor", "Delta Invest", ["Delta Invest sh", "Beta", "Vila"], ["a.pdf"], ["b.pdf"]), (1, 1, "roof", "Tjegull", ["Vila Alfa"], None, None), (1, 2, "owner", "Vila", ["Beta"], None, None)], CONFLICT)
    details = spark.createDataFrame([(1, 0, "construction_permit_number", "permits_property_licenses", "Nr. 77/9", "e:1", True, ["p.pdf"]), (1, 1, "steel_grade", "materials_and_tests", "B500C", "e:2", True, None), (1, 2, "x", "y", "Vila", "e:3", True, None), (1, 30, "x", "y", "late", "e:4", True, None), (1, 3, "x", "y", "may", "e:5", False, None)], DETAIL)
    material = spark.createDataFrame([(1, ["512 kg", " "], "Sasia e hekurit eshte 512 kg.", ["m:0"])], "draft_id int, quantities array<string>, statement string, evidence_ids array<string>")

    def issues(df):
        parts = [drafts.fact_issues(df, facts), drafts.conflict_issues(df, conflicts, facts), drafts.detail_issues(df, details), drafts.material_issues(df, material), drafts.ledger_missing(df), drafts.language_issues(df)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    found = settled(issues(d))
    by_code = Counter((r.draft_id, r.code, r.severity) for r in found.collect())
    assert by_code == Counter({(1, "PUBLIC-CANONICAL-FACT-OMITTED", "minor"): 2, (1, "PUBLIC-CONFLICT-ALTERNATIVE-USED", "major"): 1, (1, "PUBLIC-CONFLICT-ALTERNATIVE-USED", "minor"): 1, (1, "PUBLIC-DETAIL-MISSING", "major"): 2, (1, "PUBLIC-SECTION-EVIDENCE-MISSING", "major"): 1, (1, "PUBLIC-CONTEXTLESS-NUMERIC-LIST", "major"): 1, (2, "PUBLIC-CLAIM-LEDGER-MISSING", "major"): 1})

    after = settled(drafts.corrected(d, found))
    assert one(after.where("draft_id = 1")) == (
        "Vila Alfa",
        [("s0", "T0", "Ndertuesi Delta Invest sh.p.k."), ("s1", "T1", "Ndërtesa\n\nFund"), ("legal_and_administrative", "Baza ligjore dhe administrative", "Leja e ndërtimit: Nr. 77/9."), ("quality_and_hidden_works", "Materialet, provat dhe cilësia", "Steel grade: B500C.\n\nSasia e hekurit eshte 512 kg.")],
        [("c0", "s0", "Ndertuesi Delta Invest sh.p.k.", ["e", "canonical:contractor"]), ("c2", "s0", "Ndërtesa", ["e"]), ("deterministic_detail:construction_permit_number:3", "legal_and_administrative", "Leja e ndërtimit: Nr. 77/9.", ["e:1"]), ("deterministic_detail:steel_grade:4", "quality_and_hidden_works", "Steel grade: B500C.", ["e:2"]), ("deterministic_section_evidence:4", "quality_and_hidden_works", "Sasia e hekurit eshte 512 kg.", ["m:0"])],
    )
    assert one(after.where("draft_id = 2"))[1:] == ([("s0", "T0", "x")], [])
    again = settled(issues(after))
    assert again.where("draft_id = 1 and severity = 'major'").count() == 0
    twice = drafts.corrected(after, again)
    assert [tuple(r) for r in twice.orderBy("draft_id").collect()] == [tuple(r) for r in after.orderBy("draft_id").collect()]
    gate = {r.draft_id: (r.publishable, r.detail) for r in drafts.gate(d, found).collect()}
    assert gate[2] == (False, "PUBLIC-CLAIM-LEDGER-MISSING")
    assert gate[1][1].split(" | ")[0] == "PUBLIC-CONFLICT-ALTERNATIVE-USED[field=contractor, canonical=Delta Invest, used=Beta, canonical_sources=a.pdf, used_sources=b.pdf]"
    assert drafts.gate(after, again).where("draft_id = 1").collect()[0].publishable


def test_canonical_values_are_enforced(spark):
    d = spark.createDataFrame([a_draft(1, ["Me Leje ndërtimit nr. 12, protokoll nr. 5/a, datë 01.02.2020 dhe nr 12", None], [claim(0, "Pronari Beta")], "Pronari Beta", "Beta")], DRAFT)
    conflicts = spark.createDataFrame([(1, 0, "construction_permit_number", "99$", ["12"], None, None), (1, 1, "owner", "Alfa", ["Alfa", "Beta"], None, None), (1, 2, "roof", "Tulla", ["Pronari"], None, None)], CONFLICT)
    summary, sections, ledger = one(drafts.enforced(d, conflicts))
    assert summary == "Pronari Alfa"
    assert sections[0][2] == "Me Leje ndërtimit 99$ dhe nr 12"
    assert ledger == [("c0", "s0", "Pronari Alfa", ["e", "canonical:owner"])]


def test_table_facts_must_be_current(spark):
    d = spark.createDataFrame([a_draft(1, ["x"], []), a_draft(2, ["x"], [])], DRAFT)
    facts = spark.createDataFrame([(1, "owner", "A"), (1, "investor", "B"), (1, "roof", "C"), (2, "owner", "D")], FACTS)
    current = spark.createDataFrame([(1, "canonical:owner", True), (1, "canonical:investor", False)], "draft_id int, evidence_id string, is_current boolean")
    got = drafts.table_issues(d, facts, current, spark.createDataFrame([(1,)], "draft_id int"))
    assert [(r.draft_id, r.field, r.evidence_ids) for r in got.collect()] == [(1, "investor", ["canonical:investor"])]


def test_sections_are_restored(spark):
    old = spark.createDataFrame([a_draft(1, [f"p{i}" for i in range(10)], [claim(i, f"p{i}", f"s{i}") for i in (0, 3, 3)], ""), a_draft(2, ["a"], [])], DRAFT)
    new = spark.createDataFrame([(1, "Akt", "", None, [("s1", "T", "new\n\nq"), ("s1", "T", "last"), ("zz", "Z", "gone"), *[(f"s{i}", "T", f"k{i}") for i in (0, 2, 4, 5, 6, 7, 8, 9)]], [claim(0, "k0"), claim(1, "gone"), claim(2, "last", "s1"), claim(3, "k2", "s3")]), a_draft(2, ["b", "c"], None)], DRAFT)
    got = drafts.restored(new, old).orderBy("draft_id").collect()
    assert [s.body for s in got[0].sections] == ["k0", "last", "k2", "p3", *[f"k{i}" for i in range(4, 10)]]
    assert [c.statement for c in got[0].ledger] == ["k0", "last", "p3"]
    assert [s.body for s in got[1].sections] == ["b", "c"]


def test_language_is_repaired(spark):
    said = ["Punimet jane mbaruar", "Sipas dokumentacionit po", "Ura qëndron", "E sigurt"]
    ledger = [claim(0, said[0], level="not_proven"), claim(1, said[1], level="qualified"), claim(2, said[2], level="qualified"), claim(3, said[3])]
    d = spark.createDataFrame([a_draft(1, [f"{said[0]}\n\n{said[2]}", said[3]], ledger, said[2]), a_draft(2, ["x"], [])], DRAFT)
    issues = settled(drafts.language_issues(d))
    assert sorted(r.claim_id for r in issues.collect()) == ["c0", "c2"]
    summary, sections, claims = one(drafts.repaired(d, issues))
    want = ["Nga dokumentacioni i administruar nuk provohet plotësisht se punimet jane mbaruar", "Me rezervë dhe sipas dokumentacionit të administruar, Ura qëndron"]
    assert (summary, sections[0][2], [c[2] for c in claims]) == (want[1], "\n\n".join(want), [want[0], said[1], want[1], said[3]])
    assert drafts.language_issues(settled(drafts.repaired(d, issues))).count() == 0
    other = issues.unionByName(drafts.ledger_missing(d.withColumn("draft_id", F.lit(1)).withColumn("ledger", F.lit(None).cast(f"array<{drafts.CLAIM}>")).limit(1)))
    assert one(drafts.repaired(d, other))[0] == said[2]  # not language alone


# --- recognition


WORD = "page int, level int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def test_recognition_of_two_lines(spark):
    rows = [(1, 1, 0, 0, 0, 0, 0, 0, 1000, 1400, -1.0, None), (1, 5, 1, 1, 1, 2, 190, 200, 140, 30, 90.0, "Projekti"), (1, 5, 1, 1, 1, 1, 100, 200, 80, 30, 80.0, "Akt"), (1, 5, 1, 1, 2, 1, 100, 240, 120, 40, 92.0, " Vila "), (1, 5, 1, 1, 2, 2, 230, 240, 50, 40, 12.0, "zz"), (1, 5, 1, 1, 2, 3, 0, 0, 1, 1, 99.0, " "), (2, 4, 0, 0, 0, 0, 0, 0, 5, 5, -1.0, "x")]
    df = spark.createDataFrame(rows, WORD)
    pages = {r.page: (r.accepted, r.rejected, r.confidence, r.width, r.height) for r in chunks.recognised_pages(df, ["page"], 30).collect()}
    assert pages == {1: (3, 1, 88.53, 1000, 1400), 2: (0, 0, None, None, None)}
    (c,) = chunks.recognised_chunks(df, ["page"], 30).collect()
    assert (c.chunk, c.left, c.top, c.right, c.bottom, [r.confidence for r in c.regions]) == ("Akt Projekti\nVila", 100, 200, 330, 280, [87.27, 92.0])
    assert chunks.recognised_chunks(df.limit(0), ["page"], 30).count() == 0


def plain_recognition(rows, least, limit):
    pages, out = {}, []
    for r in rows:
        if r[1] == 5 and r[11] and r[10] is not None and r[10] >= least:
            pages.setdefault(r[0], {}).setdefault(r[2:5], []).append(r)
    for page, lines in pages.items():
        made = []
        for key, ws in lines.items():
            ws.sort(key=lambda w: (w[6], w[7], w[5]))
            n = [len(w[11]) for w in ws]
            made.append((min(w[7] for w in ws), min(w[6] for w in ws), key, max(w[6] + w[8] for w in ws), max(w[7] + w[9] for w in ws), sum(w[10] * k for w, k in zip(ws, n, strict=True)) / sum(n), " ".join(w[11] for w in ws)))
        now, size, groups = [], 0, []
        for line in sorted(made):
            rest, parts = line[6], []
            while len(rest) > limit:
                at = rest.rfind(" ", 0, limit + 1)
                at = at if at > 0 else limit
                parts.append(rest[:at].strip())
                rest = rest[at:].strip()
            for p in [*parts, *([rest] if rest else [])]:
                if now and size + 1 + len(p) > limit:
                    groups.append(now)
                    now, size = [], 0
                size += len(p) + (1 if now else 0)
                now.append((line, p))
        for i, g in enumerate([*groups, now] if now else groups):
            weight = sum(len(p) for _, p in g)
            out.append((page, i, "\n".join(p for _, p in g), min(x[1] for x, _ in g), min(x[0] for x, _ in g), max(x[3] for x, _ in g), max(x[4] for x, _ in g), sum(round(x[5], 2) * len(p) for x, p in g) / weight))
    return sorted(out)


def test_recognised_chunks_against_the_plain_loop(spark):
    r = random.Random(9)
    rows = [(p, 5, r.randint(0, 1), 0, r.randint(0, 6), i, r.randint(0, 9) * 10, r.randint(0, 9) * 10, r.randint(1, 50), r.randint(1, 9), r.choice([None, 10.0, 55.5, 90.25]), r.choice(["a", "bb", "cccccc", "d" * 13])) for p in range(6) for i in range(40)]
    want = plain_recognition(rows, 30, 40)
    got = sorted((c.page, c.chunk_index, c.chunk, c.left, c.top, c.right, c.bottom, c.confidence) for c in chunks.recognised_chunks(spark.createDataFrame(rows, WORD), ["page"], 30, 40).collect())
    assert [x[:7] for x in got] == [x[:7] for x in want]
    assert all(abs(a[7] - b[7]) < 0.02 for a, b in zip(got, want, strict=True))


def test_json_of_replies(spark):
    cases = {'{"b": 1, "a": {"c": [2]}}': '{"b": 1, "a": {"c": [2]}}', '```json\n{"a":1}\n```': '{"a":1}', 'It is {"a":"}"} and {no}': '{"a":"}"}', '[{"a":1}]': None, 'x {no} y {"a":1}': None, "12": None, "": None, "{": None, None: None, '"{}"': None}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string")
    got = df.select("i", labels.json_object(F.col("x")).alias("o"), F.variant_get(labels.json_value(F.col("x")), "$.a.c[0]", "int").alias("c")).orderBy("i").collect()
    assert [r.o for r in got] == list(cases.values())
    assert [r.c for r in got][:2] == [2, None]


# --- details


def same(a, b):
    a, b = (re.sub(r"\s+", "", x.lower()) for x in (a, b))
    x, y = set(re.findall("[0-9]+", a)), set(re.findall("[0-9]+", b))
    return bool(a and b) and (a in b or b in a or (len(x) >= 2 and (x <= y or y <= x)))


def test_details_against_the_plain_loop(spark):
    r = random.Random(6)
    named = {"construction permit number": ("permit_property", 1, "construction_permit_number"), "start date": ("chronology", 1, "start_date"), "concrete class": ("materials_tests", 1, "concrete_class"), "zz": ("permit_property", 4, "zz")}
    rows = [(d, f"e{i}", "permits_property_licenses", r.choice(list(named)), f"{r.choice(['Leja nr.', 'B', 'Data'])} {r.randint(1, 12)}/{r.randint(1, 3)}", "high", ["leje.pdf"]) for d in range(4) for i in range(60)]
    rows += rows[:9]
    fact = {d: f"Leja nr. {d + 2}/1" for d in range(3)}
    want = []
    for d in range(4):
        own = {(named[f][1], 1, named[f][2], -len(v), v, e, named[f][0]) for k, e, _, f, v, *_ in rows if k == d and (f != "construction permit number" or d not in fact or same(v, fact[d]))}
        got = []
        for x in sorted(own):
            if len(got) < 9 and sum(g[6] == x[6] for g in got) < 3 and not any(g[2] == x[2] and same(x[4], g[4]) for g in got):
                got.append(x)
        want += [(d, n, x[5], x[2], x[4], x[0] <= 2) for n, x in enumerate(got)]
    entries = spark.createDataFrame(rows, "d int, evidence_id string, register string, field_name string, value string, confidence_level string, sources array<string>")
    facts = spark.createDataFrame([(d, "construction_permit_number", v) for d, v in fact.items()], "d int, field string, value string")
    got = summaries.required_details(entries, facts, "d", each=3, most=9)
    assert sorted((x.d, x.n, x.evidence_id, x.field_name, x.value, x.must_include) for x in got.collect()) == sorted(want)


# --- from texts to facts


def test_contracts(spark):
    rows = [
        (1, "12.3 Kontrate_me Sh.p.k. Alfa.pdf", "unknown", "x"), (2, "Kontrate mbikeqyresi me znj. Ana Beta.docx", "letter", "Nr. Rep. 12, nr. kol. 34 dhe date 1.2.21"), (3, "a.pdf", "unknown", "KONTRATË\nSipërmarrësi: Gama shpk, Tirane\n10 rep. 11 kol."),
        (4, "a.pdf", "letter", "Kontrate\nSipermarresi: Gama"), (5, "kolaudator.pdf", None, "Kolaudatori: A ???\nKolaudatori i punimeve: ing. Delta"), (6, None, "supervisor_contract", None), (7, "b.pdf", "unknown", "Sipermarresi: pa"),
    ]
    got = extraction.contract_facts(spark.createDataFrame(rows, "id int, name string, kind string, text string"), ["id"], "name", "kind", "text")
    assert sorted((r.id, r.field, r.value) for r in got.collect()) == [(2, "supervisor", "znj. Ana Beta"), (2, "supervisor_contract_reference", "Nr. Rep. 12, Nr. Kol. 34, datë 01.02.2021"), (3, "contractor", "Gama shpk"), (3, "contractor_contract_reference", "Nr. Rep. 10, Nr. Kol. 11"), (5, "kolaudator", "ing. Delta")]


def test_table_lines(spark):
    lines = ["Sipërfaqja e tokës që zhvillohet 512,5 m2", "Siperfaqja e objektit te ri", "Siperfaqja e pergjithshme e ndertimit 900 m2 + 45.5 m² podrum", "zene nga struktura 7"]
    got = extraction.table_facts(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string"))
    assert sorted((r.i, r.field, r.value, r.extraction) for r in got.collect()) == [(0, "site_area", "512.5 m²", 0.93), (2, "basement_area", "45.5 m²", 0.92), (2, "total_construction_area", "900 m²", 0.93), (3, "footprint_area", "7 m²", 0.93)]


def test_claims_as_candidates(spark):
    docs = [(1, "a.pdf", "construction_permit", 0.0, True, "h", "Investitori: Alfa"), (2, "b.pdf", "contract_and_related_acts", 0.9, True, "h", None), (3, "c.pdf", "kolaudim_act", 0.9, True, "h", "Investitori: Model"), (4, "d.pdf", "letter", 0.9, False, "h", "Investitori: Unread")]
    d = spark.createDataFrame(docs, "version_id int, filename string, kind string, classification double, parsed boolean, sha256 string, text string")
    good, bad = [("leje ndertimi nr 7 date 01.02.2020", True)], [("x", False), (None, None)]
    said = [
        (1, "h", 0, "Porositesi", " ALFA ;", 0.7, good), (1, "h", 1, "permit number", "Nr. 7", 0.0, good), (1, "h", 2, "object name", "Vila", 0.7, bad), (1, "h", 3, "object name", "____", 0.7, good), (1, "old", 4, "object name", "Vila", 0.7, good),
        (2, "h", 0, "permit number", "Nr. 9", 0.9, good), (2, None, 1, "final value", "12 lekë", None, good), (3, "h", 0, "owner", "Model", 0.9, good), (9, "h", 0, "owner", "Nobody", 0.9, good), (2, "h", 2, None, "q q", 0.9, good), (2, "h", 3, "object name", "x", 0.9, good),
    ]
    a = spark.createDataFrame(said, "version_id int, sha string, claim_no int, field_name string, original_value string, confidence double, evidence array<struct<excerpt:string,verified:boolean>>")
    own = dossier.records(d)
    got = dossier.claim_candidates(a, own)
    assert sorted((r.filename, r.field, r.value, r.extraction, r.classification) for r in got.collect()) == [("a.pdf", "construction_permit_number", "Nr. 7", 0.5, 0.55), ("a.pdf", "investor", "ALFA", 0.7, 0.55), ("b.pdf", "final_value", "12 lekë", 0.5, 0.9)]
    facts = {r.field: (r.value, r.sources) for r in dossier.dossier_facts(d, a).collect()}
    assert facts == {"investor": ("Alfa", 1), "construction_permit_number": ("Nr. 7", 1), "final_value": ("12 lekë", 1)}
    assert dossier.dossier_facts(d.limit(0)).count() == 0


# --- prompts, findings, payloads


def test_intents_of_prompts(spark):
    cases = {
        "Shfaq projektet e mia": ["list_projects"], "Krijo një projekt të ri": ["create_project"], "Përdor projektin Alfa dhe ndrysho modelin": ["select_project", "select_ai_model"], "Cili projekt është aktiv?": ["show_active_project"],
        "Ku ka arritur progresi?": ["get_status"], "Importo dosjen": [], "Gjenero aktin e kolaudimit": ["estimate_kolaudim", "generate_kolaudim"], "Kush është sipërmarrësi?": ["answer_project_question"], "Sa është vlera e kontratës": ["answer_project_question"],
        "Importo https://drive.google.com/x dhe ruaje aty": ["import_drive_folder", "upload_report_to_drive"], "Lidh folder": [], "Lidh folder https://Drive.Google.com/x në Google Drive": ["bind_drive_folder", "upload_report_to_drive"], "Kur fillon?": [], "Ma dergo PDF, cila dosje": ["deliver_latest_report"], "": [], None: [],
    }
    df = spark.createDataFrame([(i, p) for i, p in enumerate(cases)], "i int, p string")
    got = df.select("i", reports.intent_hints(F.col("p"), F.lit(None).cast("boolean")).alias("h")).orderBy("i").collect()
    assert [r.h for r in got] == list(cases.values())
    (one_,) = df.where("i = 5").select(reports.intent_hints(F.col("p"), F.lit(True)).alias("h")).collect()
    assert one_.h == ["import_attachment"]


def test_report_payload(spark):
    head = "r int, title string, generated_at timestamp, total int, classified int, status string, reason string, summary string, signature string, sections array<struct<code:string,title:string,body:string>>"
    at = datetime.datetime(2024, 5, 6, 7, 8, 9)
    rows = [(1, "A", at, 7, 5, "drafted", "x", " S ", None, [("c", "t", "b")]), (2, "B", at, 3, 2, None, "no key", None, None, None), (3, "C", at, 4, 4, "failed", None, "", "sig", [])]
    findings = spark.createDataFrame([(1, "critical", "z"), (1, "minor", "a"), (1, "minor", "a"), (3, "major", None)], "r int, severity string, required_action string")
    facts = spark.createDataFrame([(1, "owner", "O"), (1, "location", "L"), (1, "x", "")], "r int, field string, value string")
    got = {x.r: (x.recommendation, x.required_actions, json.loads(x.payload)) for x in reports.report_payload(spark.createDataFrame(rows, head), findings, facts, ["r"]).collect()}
    assert got[1] == ("Kërkohet shqyrtim njerëzor", ["a", "z"], {"title": "A", "generated_at": "2024-05-06T07:08:09", "project": {"location": "L", "owner": "O"}, "status": "drafted", "executive_summary": "S", "sections": [{"code": "c", "title": "t", "body": "b"}], "signature_note": "", "notice": reports.NOTICE})
    assert got[2][0] == "Pa gjetje të rëndësishme" and got[2][2]["status"] == "not_generated" and got[2][2]["reason"] == "no key" and got[2][2]["executive_summary"].startswith("U kontrolluan 3 dokumente. Nuk")
    assert got[3][:2] == ("Kërkohet plotësim dokumentacioni", []) and "prej të cilave 4 u klasifikuan. Sistemi identifikoi 1 gjetje" in got[3][2]["executive_summary"] and "reason" not in got[3][2]


def test_compact_facts_and_findings(spark):
    facts = [("owner", "O", "high", ["a", " ", "b", *map(str, range(9))], None, [("s", "x" * 300), ("s", None), ("s", "y")], [("v", [" p ", "q", "r", "t"])] * 3), ("x", None, None, None, ["e"], None, None)]
    df = spark.createDataFrame(facts, "field string, value string, level string, sources array<string>, supporting array<string>, evidence array<struct<source:string,snippet:string>>, alternatives array<struct<value:string,sources:array<string>>>")
    a, b = reports.compact_facts(df).collect()
    assert (a.evidence_id, a.sources, a.supporting, [len(e.snippet) for e in a.evidence], a.evidence[0].snippet[-1], [x.sources for x in a.alternatives]) == ("canonical:owner", ["a", "b", "0", "1", "2", "3"], [], [220, 0], "…", [["p", "q", "r"]] * 2)
    assert (b.supporting, b.sources, b.evidence, b.alternatives) == (["e"], [], [], [])
    found = spark.createDataFrame([(1, "minor", "r1", 1), (1, "critical", "r2", 1), (1, "major", "r0", 1), (1, None, "r", 1), (1, "critical", "r1", 2), (1, "critical", "r1", 1)], "j int, severity string, rule string, created_at int")
    assert [tuple(r)[1:4] for r in reports.ordered_findings(found, ["j"]).orderBy("place").collect()] == [("critical", "r1", 1), ("critical", "r1", 2), ("critical", "r2", 1), ("major", "r0", 1), ("minor", "r1", 1), (None, "r", 1)]


# --- rules, coverage, consistency, a user's values


def test_rules_that_apply(spark):
    rows = [(None, True), ("{}", True), ('{"k": null}', True), ('{"k": "a"}', True), ('{"k": "b"}', False), ('{"k": ["b", "a"]}', True), ('{"k": ["b"]}', False), ('{"k": []}', False), ('{"k": 7}', True), ('{"k": {"a": 1}}', True), ("no json", True), ('["a"]', True)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "i int, x string")
    assert [r.a for r in df.select("i", audit.applies_to(F.col("x"), "k", F.lit("a")).alias("a")).orderBy("i").collect()] == [w for _, w in rows]


def test_register_coverage(spark):
    rows = [("a", "f1", "d1", "c1"), ("a", "f1", "d1", "c2"), ("a", "f2", "d2", None), ("a", None, None, None), ("b", "f", "d", "c")]
    got = audit.register_coverage(spark.createDataFrame(rows, "register string, field string, document string, chunk string"), ["a", "b", "none"])
    assert sorted(map(tuple, got.collect())) == [("a", 4, 2, 2, 2), ("b", 1, 1, 1, 1), ("none", 0, 0, 0, 0)]


def test_consistency_of_documents(spark):
    rows = [("a.pdf", "unknown", "parsed"), ("b.pdf", "unknown", "failed"), ("c.pdf", "letter", "needs_ocr"), ("d.pdf", "letter", "parsed_with_ocr"), ("e.pdf", None, None)]
    got = verification.document_issues(spark.createDataFrame(rows, "name string, kind string, status string"))
    assert sorted(map(tuple, got.collect())) == [("DOCUMENTS-UNKNOWN", 3, ["a.pdf", "b.pdf", "e.pdf"]), ("DOCUMENTS-UNREADABLE", 3, ["b.pdf", "c.pdf", "e.pdf"])]


def test_user_values_mark_conflicts(spark):
    facts = spark.createDataFrame([("a", "x", 0.5), ("b", "y", 0.5), ("c", "z", 0.5)], "field string, value string, confidence double")
    got = claims.overridden(facts, spark.createDataFrame([("a", "new"), ("b", "y"), ("d", "added")], "field string, value string"))
    marked = claims.override_conflicts(got)
    assert [(r.field, r.selected_value, r.alternatives[0].value) for r in marked.collect()] == [("a", "new", "x")]
