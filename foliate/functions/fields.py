"""Fields of claims: canonical names, where they belong, what may prove them and how their values are compared.

Nulls give null unless a function says else; field names are those that
``text.field_key`` gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliate.functions import text as t

# Other names of each canonical field.
ALIASES = {
    "object_name": ["project_name", "project_title", "object", "objekt", "objekti", "emri_objektit", "emri_i_objektit", "emertimi_objektit", "emertimi_i_objektit"],
    "location": ["object_location", "project_location", "vendndodhja", "vendndodhja_e_objektit"],
    "investor": ["developer", "client", "porositesi", "zhvilluesi", "investitori", "investor_name", "investor_name_text", "investor_text", "emri_investitorit"],
    "contractor": ["builder", "construction_company", "implementing_company", "sipermarresi", "sipermarresi_i_punimeve", "subjekti_ndertues", "zbatuesi", "contractor_name", "contractor_name_text", "contractor_text", "emri_sipermarresit", "emri_sipermarresit_text"],
    "supervisor": ["supervision_engineer", "supervising_engineer", "mbikeqyresi", "mbikqyresi", "supervizori", "supervisor_name", "supervisor_name_text", "supervisor_text", "emri_mbikqyresit", "emri_mbikeqyresit", "emri_mbikqyresit_text", "emri_mbikeqyresit_text"],
    "designer": ["design_company", "projektuesi", "designer_name", "designer_name_text", "designer_text", "emri_projektuesit", "emri_projektuesit_text"],
    "kolaudator": ["auditor", "technical_auditor", "kolaudatori", "kolaudator_name", "kolaudator_name_text", "kolaudator_text", "emri_kolaudatorit", "emri_kolaudatorit_text"],
    "construction_permit_number": ["construction_permit", "permit_number", "building_permit", "building_permit_number", "leje_ndertimi", "leja_ndertimit", "leje_ndertimit"],
    "construction_permit_protocol": ["permit_protocol", "building_permit_protocol"],
    "construction_permit_date": ["permit_date", "building_permit_date", "leje_ndertimi_date", "date_leje_ndertimi", "data_lejes_ndertimit", "data_e_lejes_se_ndertimit"],
    "start_date": ["construction_start_date", "works_start_date"],
    "completion_date": ["construction_completion_date", "works_completion_date"],
    "planned_value": ["contract_value", "approved_value"],
    "final_value": ["executed_value", "final_contract_value"],
    "document_date": ["date_of_document", "document_date", "data_dokumentit", "data_e_dokumentit"],
    "document_number": ["document_number", "nr_dokumentit", "numri_dokumentit"],
    "work_element": ["element_name", "element", "elementi", "emri_elementit", "emertimi_elementit"],
    "contractor_contract_reference": ["kontrata_sipemarrjes", "kontrata_sipermarrjes", "kontrata_e_sipermarrjes", "kontrate_sipermarrje", "kontrate_sipermarrjes"],
    "supervisor_contract_reference": ["kontrata_mbikqyresit", "kontrata_mbikqyresin", "kontrata_mbikeqyresit"],
    "kolaudator_contract_reference": ["kontrata_kolaudatorit", "kontrata_kolaudatorin", "kontrate_kolaudatorit", "kontrate_kolaudatorin"],
}
# The registers, in their order, and what sends a claim to them.
REGISTERS = ["stakeholders", "permits_property_licenses", "project_parameters", "construction_chronology", "technical_works", "materials_and_tests", "contracts_and_economics", "declarations_and_conclusions", "supporting_evidence"]
STAKEHOLDERS = ["investor", "owner", "contractor", "supervisor", "designer", "architect", "structural_engineer", "geotechnical_engineer", "electrical_engineer", "mechanical_engineer", "surveyor", "kolaudator"]
PERMIT_TERMS = ["permit", "property", "cadastral", "protocol", "license", "ownership", "parcel"]
PARAMETER_TERMS = ["area", "height", "floor", "volume", "capacity", "intensity", "coefficient", "dimension", "structure_type", "foundation_type", "seismic", "geological"]
CHRONOLOGY_TERMS = ["date", "deadline", "duration", "start", "completion", "interruption", "extension", "handover"]
ECONOMIC_TERMS = ["value", "amount", "cost", "price", "contract", "situation", "quantity", "invoice"]
MATERIAL_TERMS = ["armatur", "material", "concrete", "iron", "mass", "rebar", "reinforcement", "steel", "weight", "certificate", "laboratory", "test", "quality", "sample"]
# Which documents and words can prove a permit.
CONTRACTS = ["contract_and_related_acts", "supervisor_contract", "contractor_contract", "kolaudator_contract"]
PERMIT_FIELDS = [f"{kind}_permit_{part}" for kind in ("construction", "development") for part in ("number", "protocol", "date")]
PERMIT_WORDS = ["leje ndertimi", "leja e ndertimit", "lejes se ndertimit", "leje zhvillimi", "leja e zhvillimit", "lejes se zhvillimit", "building permit", "construction permit", "development permit"]
RICH_WORDS = ["prot", "protokoll", "date", "dat", "vendim"]
# Scopes of facts that are not canonical.
METADATA_FIELDS = ["document_date", "document_number", "protocol_number", "notary_repertory_number", "notary_collection_number"]
STAGE_FIELDS = ["work_element", "phase_name", "stage_name", "construction_phase", "hidden_work_element"]
REFERENCE_FIELDS = ["contract_reference", "contractor_contract_reference", "supervisor_contract_reference", "kolaudator_contract_reference"]
# How far a document's type is to be believed.
AUTHORITY = {
    "construction_permit": 1.0, "development_permit": 1.0, "construction_permit_conformity_declaration": 0.94, "contract_and_related_acts": 0.92, "supervisor_contract": 0.92,
    "technical_administrative_document_handover_act": 0.92, "site_handover_act": 0.9, "setting_out_act": 0.9, "start_works_minutes": 0.9, "start_works_notification": 0.88,
    "start_works_notification_letter": 0.88, "start_interruption_extension_completion_minutes": 0.9, "completion_minutes": 0.9, "technical_declaration": 0.87, "daily_site_log": 0.78,
    "project_schedule": 0.74, "monthly_situations": 0.84, "bill_of_quantities": 0.9, "approved_execution_project": 0.9, "as_built_project": 0.9, "geological_engineering_study": 0.9,
    "seismic_study": 0.9, "hidden_works_minutes": 0.88, "material_quality_certificate": 0.88, "kolaudim_act": 0.1, "unknown": 0.45,
}
CONTROL_ACTS = ["control_act", *[f"{x}_control_act" for x in ("site_setup", "structure_setting_out", "foundation_completion_and_level_0_00", "level_0_00", "structural_frame_completion", "facade_and_finishing_completion", "external_system_completion")]]
OTHER_AUTHORITY, CONTROL_AUTHORITY, STYLE_AUTHORITY, AUTHORITATIVE = 0.62, 0.93, 0.1, 0.88
PLACEHOLDER = r"(?i)(?:\?{2,}|_{3,}|\.{5,}|\bxxx\b|\btodo\b)"
UNUSABLE = ["foreign_project_reference", "style_reference", "unreadable"]


def any_of(x: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [x.contains(w) for w in terms])


def lookup(table: dict, x: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[x]


def canonical_field(x: Column) -> Column:
    """The field's canonical name; names without one stay as they are (S4). Null becomes empty."""
    key = F.coalesce(t.field_key(x), F.lit(""))
    return F.coalesce(lookup({a: c for c, names in ALIASES.items() for a in names}, key), key)


def contextual_field(x: Column, evidence: Column, kind: Column) -> Column:
    """A bare permit field goes to the permit that the document's type or the evidence names, development first."""
    key, said = F.coalesce(t.field_key(x), F.lit("")), F.coalesce(t.plain_value(evidence), F.lit(""))
    part = lookup({"permit_number": "number", "permit_protocol": "protocol", "permit_date": "date"}, key)
    of = lambda name, words: F.when((F.coalesce(kind, F.lit("")) == f"{name}_permit") | said.contains(words), F.concat(F.lit(f"{name}_permit_"), part))
    return F.coalesce(of("development", "leje zhvillimi"), of("construction", "leje ndertimi"), canonical_field(x))


def registers(category: Column, field: Column) -> Column:
    """The registers that a claim enters, in the order in which the rules name them."""
    has, term = lambda *c: category.isin(*c), lambda terms: any_of(field, terms)
    to = lambda when, *names: F.when(when, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    found = F.concat(
        to(has("party") | field.isin(*STAKEHOLDERS) | field.endswith("_nipt"), "stakeholders"),
        to(has("permit", "property") | term(PERMIT_TERMS), "permits_property_licenses"),
        to(has("material", "test") | term(MATERIAL_TERMS), "materials_and_tests"),
        to(has("contract", "economic") | term(ECONOMIC_TERMS), "contracts_and_economics"),
        to(has("chronology") | term(CHRONOLOGY_TERMS), "construction_chronology"),
        to(has("work_phase", "control_act"), "technical_works", "construction_chronology"),
        to(has("technical") & term(PARAMETER_TERMS), "project_parameters"),
        to(has("technical") & ~term(PARAMETER_TERMS), "technical_works"),
        to(has("declaration", "reservation", "conclusion"), "declarations_and_conclusions"),
        to(has("identity") | term(PARAMETER_TERMS), "project_parameters"),
    )
    return F.when(F.size(found) > 0, F.array_distinct(found)).otherwise(F.array(F.lit("supporting_evidence")))


def bare_reference(value: Column) -> Column:
    """A number alone, or one after "nr"."""
    return F.regexp_replace(t.plain_value(value), "[^a-z0-9]+", "").rlike("^(?:nr)?[0-9]{1,8}$")


def permit_context(field: Column, value: Column, evidence: Column, kind: Column) -> Column:
    """Whether a permit's field is said in words about that permit; true for other fields."""
    said = t.plain_value(F.concat(value, F.lit(" "), F.coalesce(evidence, F.lit(""))))

    def proved(said: Column) -> Column:
        own = ((kind == "construction_permit") & said.contains("leje ndertimi")) | ((kind == "development_permit") & said.contains("leje zhvillimi"))
        rich = any_of(said, PERMIT_WORDS) & any_of(said, RICH_WORDS) & (F.size(F.regexp_extract_all(said, F.lit("[0-9]+"), F.lit(0))) >= 2)
        plain = kind.isin("construction_permit", "development_permit") | any_of(said, PERMIT_WORDS)
        return own | F.when(bare_reference(value), rich).otherwise(plain)

    return ~field.isin(*PERMIT_FIELDS) | t.let(said, proved)


def admissible(field: Column, category: Column | None, value: Column, evidence: Column, kind: Column) -> Column:
    """P12, and P13 without a category: contracts prove no permits, and permits need their words. A missing type is no contract."""
    kind = F.coalesce(kind, F.lit(""))
    barred = field.isin(*PERMIT_FIELDS)
    if category is not None:
        barred = barred | F.coalesce(category.isin("permit", "property"), F.lit(False))
    return ~(kind.isin(*CONTRACTS) & barred) & permit_context(field, value, evidence, kind)


def usable(role: Column) -> Column:
    """A document without a role counts as unusable."""
    return F.coalesce(~role.isin(*UNUSABLE), F.lit(False))


def fact_value(field: Column, value: Column) -> Column:
    """For dates the first day in the value; else folded words without titles and labels."""
    plain = F.regexp_replace(t.plain_value(value), r"\b(z|znj|ing|inxh|ark|shoqeria|shpk|sh p k|nr|prot)\b", " ")
    first = F.get(t.days(value), F.lit(0))
    words = t.squeeze(F.regexp_replace(plain, "[^a-z0-9]+", " "))
    return F.when(field.endswith("_date"), F.coalesce(first, words)).otherwise(words)


# Where a field's value ends.
STOPS = {
    "object_name": r"(?i),?\s*(?:me\s+adres[eë]|n[eë]\s+Fshat|Fshati\s+|me\s+Leje|Investitori\s*:|q[eë]\s+ndodhet).*$",
    "location": r"(?i),?\s*(?:me\s+Leje|me\s+Vendim|Investitori\s*:).*$",
    "investor": r"(?i),?\s*(?:i\s+dat[eë]lindjes|me\s+NID|me\s+nr\.?\s+personal|k[eë]tu\s+e).*$",
    "contractor": r"(?i),?\s*(?:me\s+Li[cç]|me\s+NIPT|p[eë]rfaq[eë]suar|me\s+seli).*$",
    "supervisor": r"(?i),?\s*(?:me\s+profesion|i\s+pajisur|me\s+Li[cç]|me\s+nr\.?\s+Li[cç]).*$",
    "kolaudator": r"(?i),?\s*(?:me\s+profesion|i\s+pajisur|me\s+Li[cç]|me\s+nr\.?\s+Li[cç]|Identifikuar).*$",
    "designer": r"(?i),?\s*(?:me\s+Li[cç]|Li[cç]\s*:).*$",
}
NARRATIVE = ["zerat e punimeve", "punimeve jane", "realizuar sipas", "ndryshimeve te miratuara", "organet perkatese"]


NAME_LABEL = r"(?i)^(?:emri|em[eë]rtimi)\s+i\s+objektit\s*:\s*"
NEVER = r"(?!)"


def clean_value(field: Column, value: Column) -> Column:
    """The value without quotes, labels and what follows it, 220 characters at most; null for placeholders, for nothing and for a designer's narrative.

    The field's one pattern is looked up, so that the expression names each step once.
    """
    quotes = '"“”'
    v = F.regexp_replace(F.trim(F.trim(value), F.lit(quotes)), F.when(field == "object_name", NAME_LABEL).otherwise(NEVER), F.lit(""))
    v = F.trim(F.regexp_replace(v, F.coalesce(lookup(STOPS, field), F.lit(NEVER)), F.lit("")))
    v = F.regexp_replace(F.trim(F.substring_index(v, "|", 1)), r"(?i),?\s+me\s*$", "")

    def kept(v: Column) -> Column:
        story = F.when(field == "designer", (F.length(v) > 100) | any_of(t.plain_value(v), NARRATIVE)).otherwise(F.lit(False))
        return F.when((v != "") & ~v.rlike(PLACEHOLDER) & ~story, F.left(v, F.lit(220)))

    return t.let(F.trim(v, F.lit(quotes + " ;,.")), kept)


def fact_scope(field: Column) -> Column:
    """Where a fact that is not canonical is listed."""
    return (
        F.when(field.isin(*METADATA_FIELDS) | field.endswith("_document_date"), "document_metadata")
        .when(field.isin(*STAGE_FIELDS) | field.contains("element") | field.contains("phase"), "work_stages")
        .when(field.isin(*REFERENCE_FIELDS) | field.contains("contract_reference"), "contract_references")
        .otherwise("supporting_facts")
    )


def authority(kind: Column, style: Column) -> Column:
    """K9: by the document's type; control acts and other types have one value each, models of acts the least."""
    return F.when(style, STYLE_AUTHORITY).when(kind.isin(*CONTROL_ACTS), CONTROL_AUTHORITY).otherwise(F.coalesce(lookup(AUTHORITY, F.coalesce(kind, F.lit(""))), F.lit(OTHER_AUTHORITY)))


def document_role(parsed: Column, kind: Column, style: Column) -> Column:
    """K9: what a document counts as."""
    return F.when(~parsed, "unreadable").when(style, "style_reference").when(authority(kind, F.lit(False)) >= AUTHORITATIVE, "authoritative_evidence").otherwise("supporting_evidence")


def style_reference(name: Column, kind: Column, text: Column) -> Column:
    """K9: a model of an act: of that type, or so named and marked by an x or by placeholders in the text."""
    named = t.plain_value(name).contains("akt kolaudimi") & (F.lower(name).startswith("x.") | F.coalesce(text.rlike(PLACEHOLDER), F.lit(False)))
    return F.coalesce(kind == "kolaudim_act", F.lit(False)) | F.coalesce(named, F.lit(False))


def foreign_name(name: Column) -> Column:
    """K9: a file of another project, by an x before its name."""
    base = F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1)
    return base.rlike(r"(?i)^x(?:\.|[ _-])") | t.plain_value(base).startswith("x a ")
