"""The plan of a report: its sections with the facts, files, entries and reviews that each may draw on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# K28, the sections in order: title, fields of facts, sections of evidence, registers, domains of review.
SECTIONS = {
    "legal_basis_and_scope": ("Baza ligjore dhe objekti i kolaudimit", ["object_name", "location"], ["legal_and_administrative"], ["permits_property_licenses"], ["legal_administrative"]),
    "project_identity_and_parties": ("Identifikimi i objektit dhe palëve përgjegjëse", ["investor", "contractor", "contractor_license", "supervisor", "supervisor_license", "designer", "kolaudator", "kolaudator_license"], ["parties_and_contracts"], ["stakeholders"], ["legal_administrative"]),
    "permits_property_and_approved_design": ("Lejet, pronësia dhe projekti i miratuar", ["development_permit_number", "construction_permit_number", "construction_permit_protocol", "construction_permit_date", "property_number", "cadastral_zone"], ["legal_and_administrative", "design_and_parameters"], ["permits_property_licenses", "project_parameters"], ["legal_administrative", "project_parameters"]),
    "technical_parameters": ("Të dhënat dhe parametrat teknikë të objektit", ["site_area", "footprint_area", "total_construction_area", "maximum_height", "floors_above_ground", "floors_below_ground"], ["design_and_parameters"], ["project_parameters"], ["project_parameters"]),
    "geology_seismicity_and_setting_out": ("Kushtet gjeologo-inxhinierike, sizmike dhe piketimi", ["soil_bearing_capacity", "seismic_intensity"], ["design_and_parameters", "execution_and_chronology"], ["project_parameters", "technical_works"], ["project_parameters", "structural_hidden_works"]),
    "contracts_values_and_deadlines": ("Kontratat, vlerat dhe afatet", ["planned_value", "final_value", "start_date", "completion_date"], ["parties_and_contracts", "technical_economic"], ["contracts_and_economics", "stakeholders"], ["contractual_economic", "chronology_completion"]),
    "execution_chronology": ("Ecuria dhe fazat e realizimit të punimeve", ["start_date", "completion_date"], ["execution_and_chronology"], ["construction_chronology"], ["chronology_completion"]),
    "hidden_works_and_structure": ("Punimet e maskuara dhe elementet konstruktive", [], ["quality_and_hidden_works", "execution_and_chronology"], ["technical_works"], ["structural_hidden_works"]),
    "materials_tests_and_quality": ("Materialet, provat dhe kontrolli i cilësisë", [], ["quality_and_hidden_works"], ["materials_and_tests"], ["materials_quality"]),
    "measurements_and_conformity": ("Matjet përfundimtare dhe përputhshmëria me projektin", ["site_area", "footprint_area", "total_construction_area"], ["design_and_parameters", "completion_and_conclusion"], ["project_parameters", "technical_works"], ["project_parameters", "structural_hidden_works"]),
    "technical_economic_conclusion": ("Konkluzioni tekniko-ekonomik", ["final_value"], ["technical_economic", "completion_and_conclusion"], ["contracts_and_economics", "declarations_and_conclusions"], ["contractual_economic", "chronology_completion", "structural_hidden_works", "materials_quality"]),
    "copies_and_signatures": ("Hartimi i aktit dhe nënshkrimet", ["investor", "contractor", "supervisor", "kolaudator"], [], ["stakeholders"], ["legal_administrative"]),
}


def plan_rows() -> Column:
    """The plan as an array of (n, code, title, facts, evidence, registers, domains), one for each section."""
    names = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    rows = [(F.lit(n), F.lit(code), F.lit(title), *map(names, lists)) for n, (code, (title, *lists)) in enumerate(SECTIONS.items())]
    return F.array(*[F.struct(*[v.alias(c) for v, c in zip(r, ("n", "code", "title", "facts", "evidence", "registers", "domains"), strict=True)]) for r in rows])


def planned(at: int) -> list[str]:
    """All names of the plan's ``at``-th list."""
    return sorted({x for _, *lists in SECTIONS.values() for x in lists[at]})


def section_plan(projects: DataFrame, facts: DataFrame, files: DataFrame, entries: DataFrame, memoranda: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, code, title, available, missing, files, entries, reviews) of each section of each project (by).

    ``facts``: by, field, value (blank ones are missing). ``files``: by, section, filename (A18). ``entries``: by, register.
    ``memoranda``: by, domain, status, statements. ``available`` and ``missing`` are fields in the plan's order, ``files`` sorted
    names, ``entries`` (register, n) with 0 for none, ``reviews`` (domain, status, statements) of those that there are. Each table is
    brought to one row for each project, which holds no more than the plan's names and the project's files; the sections are written
    out only when these rows have met, so that what is shuffled or broadcast doesn't hold the plan for each project.
    """
    own = projects.select(*by).distinct()
    known = facts.where(F.col("field").isin(*planned(0)) & (F.trim(F.coalesce("value", F.lit(""))) != "")).groupBy(*by).agg(F.collect_set("field").alias("known"))
    named = files.where(F.col("section").isin(*planned(1)) & F.col("filename").isNotNull()).groupBy(*by).agg(F.collect_set(F.struct("section", "filename")).alias("named"))
    is_of = lambda c, v: F.col(c) == v
    counts = entries.groupBy(*by).agg(F.create_map(*[x for r in planned(2) for x in (F.lit(r), F.count_if(is_of("register", r)))]).alias("counts"))
    review = lambda d: F.max_by(F.when(is_of("domain", d), F.struct("status", "statements")), F.when(is_of("domain", d), F.col("status")))
    memo = memoranda.groupBy(*by).agg(F.create_map(*[x for d in planned(3) for x in (F.lit(d), review(d))]).alias("memo"))
    for part in (known, named, counts, memo):
        own = own.join(part, by, "left")
    x = own.select("*", F.explode(plan_rows()).alias("p")).select("*", "p.*")
    there = lambda f: F.coalesce(F.array_contains("known", f), F.lit(False))
    shown = F.transform(F.filter("named", lambda f: F.array_contains(F.col("evidence"), f["section"])), lambda f: f["filename"])
    of = lambda c, name: F.try_element_at(F.col(c), name)
    told = F.filter("domains", lambda d: of("memo", d).isNotNull())
    return x.select(
        *by, "n", "code", "title", F.filter("facts", there).alias("available"), F.filter("facts", lambda f: ~there(f)).alias("missing"),
        F.coalesce(F.array_sort(F.array_distinct(shown)), F.array().cast("array<string>")).alias("files"),
        F.transform("registers", lambda r: F.struct(r.alias("register"), F.coalesce(of("counts", r), F.lit(0)).alias("n"))).alias("entries"),
        F.transform(told, lambda d: F.struct(d.alias("domain"), of("memo", d)["status"].alias("status"), of("memo", d)["statements"].alias("statements"))).alias("reviews"),
    )


def readiness(projects: DataFrame, missing: DataFrame, conflicts: DataFrame, by: list[str]) -> DataFrame:
    """(by, readiness) of each project, by its missing core fields (by, field) and then its conflicts (by, field)."""
    lacks = missing.select(*by, F.lit(True).alias("lacks")).distinct()
    differs = conflicts.select(*by, F.lit(True).alias("differs")).distinct()
    x = projects.select(*by).distinct().join(lacks, by, "left").join(differs, by, "left")
    state = F.when(F.col("lacks"), "generating_with_qualified_gaps").when(F.col("differs"), "generating_with_resolved_conflicts").otherwise("evidence_ready")
    return x.select(*by, state.alias("readiness"))
