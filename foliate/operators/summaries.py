"""Counts of collections, and selections within budgets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import fields
from foliate.functions import text as t


def status_counts(docs: DataFrame, by: list[str], status: str, kind: str, unknown: str = "unknown") -> DataFrame:
    """A1, A2: of each group its documents, those of each status and of each type but unknown ones (maps, keys sorted), and the unknown ones."""
    n = docs.groupBy(*by, status, kind).agg(F.count(F.lit(1)).alias("n"))
    summed = lambda key, rows: rows.groupBy(*by, key).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(f"by_{key}"))
    total = n.groupBy(*by).agg(F.sum("n").alias("documents"), F.coalesce(F.sum(F.when(F.col(kind) == unknown, F.col("n"))), F.lit(0)).alias("unknown"))
    return total.join(summed(status, n), by, "left").join(summed(kind, n.where(F.col(kind) != unknown)), by, "left")


def parse_summary(found: DataFrame, expected: DataFrame, by: str, status: str, name: str) -> DataFrame:
    """A3: of each expected group the names by status (sorted) and how many of the expected (by, n) are missing."""
    held = found.groupBy(by, status).agg(F.array_sort(F.collect_list(name)).alias("names"), F.count(F.lit(1)).alias("n"))
    held = held.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "names")))).alias("names"), F.sum("n").alias("_found"))
    return expected.join(held, by, "left").select(by, "names", F.greatest(F.col("n") - F.coalesce("_found", F.lit(0)), F.lit(0)).alias("missing"))


def generation_estimate(docs: DataFrame, cached: DataFrame, key: str, chars: str, batches: str, output_limit: int, overhead: int = 1600) -> DataFrame:
    """Rows (stage, documents, cache_hits, calls, input_tokens, output_tokens) of extraction and synthesis, and their total.

    Documents (key, chars, batches) that are cached cost no calls; others cost a
    call for each batch, with ``overhead`` tokens and a quarter of the characters.
    """
    x = docs.join(cached.select(key, F.lit(True).alias("_hit")).distinct(), key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    calls = F.when(F.col("_hit"), 0).otherwise(F.col(batches))
    tokens = F.when(F.col("_hit"), 0).otherwise(F.col(batches) * overhead + F.ceil(F.col(chars) / 4))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    one = x.agg(F.count(F.lit(1)).alias("documents"), F.count_if("_hit").alias("cache_hits"), s(calls).alias("calls"), s(tokens).alias("input_tokens"), s(calls * output_limit).alias("output_tokens"), s(t.estimated_tokens(F.col(chars))).alias("_all"))
    stage = lambda name, *c: one.select(F.lit(name).alias("stage"), *[v.cast("long").alias(n) for v, n in zip(c, ("documents", "cache_hits", "calls", "input_tokens", "output_tokens"), strict=True)])
    col, lit = F.col, F.lit
    extraction = stage("extraction", *map(col, ("documents", "cache_hits", "calls", "input_tokens", "output_tokens")))
    synthesis = stage("synthesis", col("documents"), lit(0), lit(1), col("_all"), lit(output_limit))
    total = stage("total", col("documents"), col("cache_hits"), col("calls") + 1, col("input_tokens") + col("_all"), col("output_tokens") + output_limit)
    return extraction.unionByName(synthesis).unionByName(total)


def files_by_section(docs: DataFrame, section: str, name: str, role: str) -> DataFrame:
    """Of each section the distinct names of its usable documents, sorted: a row for each, numbered."""
    x = docs.where(fields.usable(F.col(role))).select(section, name).distinct()
    return x.withColumn("n", F.row_number().over(Window.partitionBy(section).orderBy(name)))


def inventory(docs: DataFrame, by: list[str], parsed: Column, kind: str) -> DataFrame:
    """Of each group its documents, those read, those read and unknown, and the types."""
    return docs.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), F.count_if(parsed).alias("parsed"), F.count_if(parsed & (F.col(kind) == "unknown")).alias("unknown"), F.countDistinct(kind).alias("kinds"))


def dossier_summary(docs: DataFrame, facts: DataFrame, entries: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row of counts of a dossier: documents by role, fields with facts, entries, registers, conflicts."""
    pairs = [docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("role") == "authoritative_evidence").alias("authoritative"), F.count_if(F.col("role") == "style_reference").alias("style"), F.count_if(F.col("role") == "unreadable").alias("unreadable")), facts.agg(F.countDistinct("field").alias("facts")), entries.agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("register").alias("registers")), conflicts.agg(F.count(F.lit(1)).alias("conflicts"))]
    out = pairs[0].withColumn("_k", F.lit(1))
    for p in pairs[1:]:  # each of them is one row
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def document_relations(docs: DataFrame, facts: DataFrame, selected: DataFrame, document: str) -> DataFrame:
    """Documents (document, role, name) with their relation to the project and, for foreign ones, a new role and authority.

    ``facts``: document, field, value of anchor fields; ``selected``: field,
    chosen. Models and unreadable ones keep that as relation; a foreign name
    decides; else agreement (S35 over S6) with what is selected.
    """
    x = facts.join(selected, "field")
    a, b = fields.fact_value(F.col("field"), F.col("value")), fields.fact_value(F.col("field"), F.col("chosen"))
    same = (a != "") & (b != "") & t.same_or_within(a, b)
    n = x.where("chosen <> ''").groupBy(document).agg(F.count_if(same).alias("_same"), F.count_if(~same).alias("_other"))
    y = docs.join(n, document, "left")
    m, c = F.coalesce("_same", F.lit(0)), F.coalesce("_other", F.lit(0))
    relation = (
        F.when(F.col("role").isin("style_reference", "unreadable"), F.col("role"))
        .when(fields.foreign_name(F.col("name")), "foreign_project_reference")
        .when((m >= 2) | ((m >= 1) & (c == 0)), "target_project")
        .when(c >= 2, "foreign_project_reference")
        .otherwise("unlinked_supporting")
    )
    y = y.withColumn("relation", relation)
    return y.withColumn("role", F.when(F.col("relation") == "foreign_project_reference", F.col("relation")).otherwise(F.col("role"))).drop("_same", "_other")


# W5, groups and priorities of details by field, by word, and by register.
EXACT = {
    "construction_permit_number": ("permit_property", 1), "construction_permit_protocol": ("permit_property", 1), "construction_permit_date": ("permit_property", 1),
    "development_permit_number": ("permit_property", 2), "development_permit_protocol": ("permit_property", 2), "development_permit_date": ("permit_property", 2),
    "property_number": ("permit_property", 2), "cadastral_zone": ("permit_property", 2), "parcel_number": ("permit_property", 3), "ownership_certificate": ("permit_property", 3),
    "contractor_contract_reference": ("contracts_economic", 1), "supervisor_contract_reference": ("contracts_economic", 1), "kolaudator_contract_reference": ("contracts_economic", 1),
    "planned_value": ("contracts_economic", 2), "final_value": ("contracts_economic", 2), "contract_value": ("contracts_economic", 2), "contract_date": ("contracts_economic", 3), "contract_deadline": ("contracts_economic", 3),
    "start_date": ("chronology", 1), "completion_date": ("chronology", 1), "site_handover_date": ("chronology", 2), "setting_out_date": ("chronology", 2), "foundation_completion_date": ("chronology", 2),
    "structural_frame_completion_date": ("chronology", 2), "facade_completion_date": ("chronology", 2), "external_system_completion_date": ("chronology", 2),
    "total_construction_area": ("technical_parameters", 1), "construction_area": ("technical_parameters", 1), "building_area": ("technical_parameters", 1), "basement_area": ("technical_parameters", 2),
    "floor_count": ("technical_parameters", 2), "structure_type": ("technical_parameters", 2), "foundation_type": ("technical_parameters", 2), "bearing_capacity": ("technical_parameters", 2), "seismic_category": ("technical_parameters", 3),
    "concrete_class": ("materials_tests", 1), "steel_grade": ("materials_tests", 1), "protective_layer": ("materials_tests", 2), "material_certificate": ("materials_tests", 2), "concrete_test_result": ("materials_tests", 2), "steel_test_result": ("materials_tests", 2),
}
BY_WORD = [
    ("permit_property", 2, ["permit", "protocol", "cadastral", "property", "parcel"]), ("contracts_economic", 2, ["contract", "value", "amount", "cost", "price"]), ("chronology", 3, ["date", "deadline", "duration", "start", "completion"]),
    ("technical_parameters", 3, ["area", "floor", "height", "foundation", "geological", "seismic"]), ("materials_tests", 3, ["concrete", "steel", "material", "certificate", "test", "quality", "layer"]),
]
BY_REGISTER = {"permits_property_licenses": "permit_property", "contracts_and_economics": "contracts_economic", "construction_chronology": "chronology", "project_parameters": "technical_parameters", "materials_and_tests": "materials_tests"}
REGISTER_PLACE = {"permits_property_licenses": 1, "contracts_and_economics": 2, "construction_chronology": 3, "project_parameters": 4, "materials_and_tests": 5, "technical_works": 6}
PERSONS = ["legal_representative", "representative", "administrator", "authorized_person"]


def detail_group(register: Column, field: Column) -> Column:
    """(group, priority) of a field: by name, else by word, else by register at 4; null for none."""
    pair = lambda g, p: F.struct(g.alias("group"), p.alias("priority"))
    lit = lambda g, p: pair(F.lit(g), F.lit(p))
    out = F.when(field.isin(*EXACT), pair(fields.lookup({k: g for k, (g, _) in EXACT.items()}, field), fields.lookup({k: p for k, (_, p) in EXACT.items()}, field)))
    for g, p, words in BY_WORD:
        out = out.when(fields.any_of(F.lower(field), words), lit(g, p))
    return out.when(register.isin(*BY_REGISTER), pair(fields.lookup(BY_REGISTER, register), F.lit(4)))


def required_details(entries: DataFrame, facts: DataFrame, by: str, each: int = 5, most: int = 24) -> DataFrame:
    """Of each ``by`` the details that a report must give, in their order.

    ``entries``: by, evidence_id, register, field_name, value, confidence_level,
    sources (array). ``facts``: by, field, value. Stakeholders, representatives and
    general fields go; permits must equal the canonical value (S38), and bare
    numbers of permits need a permit among their sources. In order of priority,
    register, field, length and value, up to ``each`` of a group and ``most`` in
    all, one that equals an earlier one of its field (S38) is left out.
    """
    x = entries.withColumns({"field": fields.canonical_field(F.col("field_name")), "value": t.squeeze(F.col("value"))}).where("field <> '' and value <> ''")
    x = x.where(~F.col("field").isin(*fields.STAKEHOLDERS, "contract_reference", "permit_type") & ~fields.any_of(F.col("field"), PERSONS))
    x = x.join(facts.select(by, F.col("field"), t.squeeze(F.col("value")).alias("_fact")), [by, "field"], "left")
    names = t.compact(F.array_join("sources", " "))
    trusted = (F.lower(F.coalesce("confidence_level", F.lit(""))) == "high") & ~fields.any_of(names, ["proces", "verbal", "fillim"]) & fields.any_of(names, ["leje", "permit", "constructionpermit", "developmentpermit"])
    permit = F.col("field").isin(*fields.PERMIT_FIELDS)
    x = x.where(~permit | (F.coalesce("_fact", F.lit("")) == "") | t.inside_or_numbers(F.col("value"), F.col("_fact"))).where(~permit | ~fields.bare_reference(F.col("value")) | trusted)
    x = x.withColumn("_g", detail_group(F.col("register"), F.col("field"))).where("_g is not null").select("*", "_g.group", "_g.priority")
    place = {"place": F.coalesce(fields.lookup(REGISTER_PLACE, F.col("register")), F.lit(99)), "size": F.negative(F.length("value"))}
    order = ["priority", "place", "field", "size", "value", "evidence_id", "register", "group"]
    rows = x.withColumns(place).select(by, *order).distinct()  # before the shuffle, as far as a task sees repeats
    kind = rows.schema[by].dataType.simpleString()
    out = rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(lambda b: first_details(b, by, each, most), f"{by} {kind}, n int, evidence_id {rows.schema['evidence_id'].dataType.simpleString()}, group string, register string, field_name string, value string, priority int")
    return out.withColumn("must_include", F.col("priority") <= 2)


def first_details(batches: Iterator[pa.RecordBatch], by: str, each: int, most: int) -> Iterator[pa.RecordBatch]:
    """Of sorted rows the details that stay: a report's rows stream by, and no more than ``most`` of them are held."""
    report, begun = None, False
    held: list[tuple[str, str, str, set[str]]] = []
    for batch in batches:
        kept, numbers = [], []
        names = ("evidence_id", "group", "register", "field", "value", "priority")
        for i, (key, group, field, value) in enumerate(zip(*(batch.column(c).to_pylist() for c in (by, "group", "field", "value")), strict=True)):
            if not begun or key != report:
                report, begun, held = key, True, []
            if len(held) >= most or sum(g == group for g, *_ in held) >= each:
                continue
            short = re.sub(r"\s+", "", value.lower())
            said = set(re.findall("[0-9]+", short))
            if any(f == field and same_detail(short, said, other, theirs) for _, f, other, theirs in held):
                continue
            kept.append(i)
            numbers.append(len(held))
            held.append((group, field, short, said))
        rows = batch.take(pa.array(kept, pa.int64()))
        cols = [rows.column(by), pa.array(numbers, pa.int32()), *[rows.column(c) for c in names]]
        yield pa.RecordBatch.from_arrays(cols, names=[by, "n", "evidence_id", "group", "register", "field_name", "value", "priority"])


def same_detail(a: str, own: set[str], b: str, theirs: set[str]) -> bool:
    """S38 for two values without white space, in lower case, and their numbers."""
    return bool(a and b) and (a in b or b in a or (len(own) >= 2 and (own <= theirs or theirs <= own)))


def within_budget(items: DataFrame, by: str, size: str, priority: list, budget: int) -> DataFrame:
    """Items of each group dropped, the least wanted first, until the rest fits: those whose total, the most wanted first, is within ``budget``."""
    total = F.sum(size).over(Window.partitionBy(by).orderBy(*priority).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("total", total).where(F.col("total") <= budget)


def domain_conflicts(conflicts: DataFrame, registers: DataFrame, domains: DataFrame) -> DataFrame:
    """Conflicts (conflict_id, field) for each domain (domain, register) that a register of their field (field, register) belongs to; those of none for all domains."""
    # Fields are as many as a vocabulary has and conflicts are often of few, so that a shuffle by field would put most into one task.
    of = registers.join(domains, "register").select("field", "domain").distinct()
    own = conflicts.join(F.broadcast(of), "field").select("conflict_id", "field", "domain").distinct()
    rest = conflicts.join(own.select("conflict_id").distinct(), "conflict_id", "left_anti")
    # All names of domains as one array, which each conflict of none gets: a review has a handful.
    names = domains.agg(F.array_sort(F.collect_set("domain")).alias("domain")).withColumn("every", F.lit(True))
    rest = rest.withColumn("every", F.lit(True)).join(F.broadcast(names), "every").select("conflict_id", "field", F.explode("domain").alias("domain"))
    return own.unionByName(rest)
