"""Packets of evidence for specialists: what a domain gets, how a packet shrinks to its budget, and which statements stand.

``by`` names the columns of a packet. Nulls in scores count as 0, in sizes as nothing; empty tables give empty ones.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import text as t
from foliate.operators import evidence

# K27, domains of review with their registers in order, and the entries that a register keeps.
DOMAINS = {
    "legal_administrative": ("permits_property_licenses", "stakeholders"),
    "project_parameters": ("project_parameters", "permits_property_licenses"),
    "chronology_completion": ("construction_chronology", "declarations_and_conclusions"),
    "structural_hidden_works": ("technical_works", "construction_chronology"),
    "materials_quality": ("materials_and_tests", "technical_works"),
    "contractual_economic": ("contracts_and_economics", "stakeholders", "declarations_and_conclusions"),
}
FLOORS = {
    "stakeholders": 4, "permits_property_licenses": 3, "project_parameters": 3, "construction_chronology": 4, "technical_works": 4,
    "materials_and_tests": 3, "contracts_and_economics": 3, "declarations_and_conclusions": 1, "supporting_evidence": 0,
}
#: Entries of a register in a packet, and the sources that each names.
PER_REGISTER, PER_ENTRY = 24, 3
#: Steps of shrinking, after which a packet stays as large as it is.
STEPS = 300


def json_tokens(chars: Column) -> Column:
    """Three characters of JSON a token, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(chars / 3))


def packet_entries(entries: DataFrame, by: list[str], most: int = PER_REGISTER) -> DataFrame:
    """Of each register the first ``most`` public entries (by, register, n, field, value, normalized), named ``register:n``."""
    public = entries.where(evidence.public_entry(F.col("field"), F.col("value"), F.col("normalized")))
    kept = public.withColumn("place", F.row_number().over(Window.partitionBy(*by, "register").orderBy("n"))).where(F.col("place") <= most)
    shown = evidence.public_value(F.col("field"), F.col("value"), F.col("normalized"))
    return kept.withColumns({"evidence_id": F.concat("register", F.lit(":"), F.col("n").cast("string")), "shown": shown})


def domain_table(spark, domains: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(domain, register, register_place) of the domains, a handful of rows."""
    rows = [(d, r, i) for d, registers in (domains or DOMAINS).items() for i, r in enumerate(registers)]
    return spark.createDataFrame(rows, "domain string, register string, register_place int")


def domain_evidence(entries: DataFrame, concerns: DataFrame, by: list[str], domains: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(by, domain, evidence_id) of what each domain may cite.

    Entries (by, register, field, evidence_id) go to the domains of their register. Concerns (by, evidence_id, kind, field, code): a
    conflict goes to the domains that have an entry of its field, an order of days to chronology alone, and those of none to all.
    """
    d = F.broadcast(domain_table(entries.sparkSession, domains))
    own = entries.join(d, "register").select(*by, "domain", "evidence_id", "field")
    fields = own.select(*by, "domain", F.col("field")).where("field is not null").distinct()
    late = F.col("code") == "DOSSIER-CHRONOLOGY-ORDER"
    conflict = F.col("kind") == "canonical_conflict"
    met = concerns.where(conflict).join(fields, [*by, "field"]).select(*by, "domain", "evidence_id").distinct()
    alone = concerns.where(~conflict & F.coalesce(late, F.lit(False))).select(*by, F.lit("chronology_completion").alias("domain"), "evidence_id")
    placed = met.unionByName(alone)
    every = F.explode(F.array(*map(F.lit, domains or DOMAINS))).alias("domain")
    rest = concerns.join(placed.select(*by, "evidence_id").distinct(), [*by, "evidence_id"], "left_anti").select(*by, every, "evidence_id")
    return own.select(*by, "domain", "evidence_id").unionByName(placed).unionByName(rest)


def register_counts(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, register, n) of the entries that may be taken away."""
    return entries.where("removable").groupBy(*by, "register").agg(F.count(F.lit(1)).alias("n"))


def shrunk(packets: DataFrame, entries: DataFrame, by: list[str], floors: dict[str, int] | None = None, steps: int = STEPS) -> DataFrame:
    """The entries that are left of packets over budget, with ``sources``, the sizes of the sources that each keeps.

    ``packets``: by, budget (tokens), fixed (characters of all else). ``entries``: by, place (their order), register, removable,
    confidence, corroboration, size (characters without sources), sources (array of sizes).

    While a packet is over its budget, step by step: the longest list of sources loses its last (ties: the first list), until all
    lists hold one; then the least entry by (confidence, corroboration, place) goes, of those whose register holds more than its
    floor (1, if it is not named). As the longest list goes first, sources go by falling position: the level that lists are cut to is
    found on positions alone. As a register loses its least first, what may go of it is the same whichever register is next. So both
    orders are known beforehand, and a step is taken where what went before leaves the packet over. Steps are few, so that windows
    keep no more rows of a packet than that.
    """
    own, floors = Window.partitionBy(*by), floors or FLOORS
    rest = F.coalesce(F.col("sources"), F.array().cast("array<int>"))
    rows = entries.withColumns({"sources": rest, "size": F.coalesce("size", F.lit(0))})
    sizes = F.aggregate("sources", F.lit(0).cast("long"), lambda s, v: s + v)
    total = rows.groupBy(*by).agg(F.sum(F.col("size") + sizes).alias("sum"), F.sum(F.greatest(F.lit(0), F.size("sources") - 1)).alias("spare"))
    whole = packets.join(total, by, "left").withColumn("total", F.coalesce("fixed", F.lit(0)) + F.coalesce("sum", F.lit(0)))
    over = lambda chars: json_tokens(chars) > F.col("budget")
    large = whole.where(over(F.col("total"))).select(*by, "budget", "total", "spare")

    pops = rows.select(*by, "place", F.posexplode("sources").alias("i", "s")).where("i > 0")
    by_length = [F.desc("i"), F.asc("place")]
    pops = pops.withColumn("step", F.row_number().over(own.orderBy(*by_length))).where(F.col("step") <= steps)
    before = F.coalesce(F.sum("s").over(own.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    popped = pops.withColumn("before", before).join(large, by).where(over(F.col("total") - F.col("before")))
    lost = popped.groupBy(*by, "place").agg(F.count(F.lit(1)).alias("lost"))
    gone = popped.groupBy(*by).agg(F.count(F.lit(1)).alias("taken"), F.sum("s").alias("popped"))

    # Entries go from packets all of whose lists hold one, and that are still over.
    second = large.join(gone, by, "left").withColumns({"taken": F.coalesce("taken", F.lit(0)), "left": F.col("total") - F.coalesce("popped", F.lit(0))})
    second = second.where((F.col("taken") == F.col("spare")) & over(F.col("left"))).select(*by, "budget", "taken", "left")
    least = [F.coalesce("confidence", F.lit(0.0)), F.coalesce("corroboration", F.lit(0)), "place"]
    floor = F.coalesce(F.create_map(*map(F.lit, chain(*floors.items())))[F.col("register")], F.lit(1))
    last = rows.where("removable").withColumn("rank", F.row_number().over(Window.partitionBy(*by, "register").orderBy(*least))).where(F.col("rank") <= steps)
    last = last.join(register_counts(rows, by), [*by, "register"]).where(F.col("rank") <= F.col("n") - floor)
    last = last.withColumn("step", F.row_number().over(own.orderBy(*least))).where(F.col("step") <= steps)
    weight = F.col("size") + F.coalesce(F.get("sources", F.lit(0)), F.lit(0))
    last = last.withColumn("before", F.coalesce(F.sum(weight).over(own.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    removed = last.join(second, by).where((F.col("step") <= steps - F.col("taken")) & over(F.col("left") - F.col("before"))).select(*by, "place")

    left = rows.join(removed, [*by, "place"], "left_anti").join(lost, [*by, "place"], "left")
    return left.withColumn("sources", F.slice("sources", F.lit(1), F.size("sources") - F.coalesce("lost", F.lit(0)).cast("int"))).drop("lost")


def allowed_statements(statements: DataFrame, allowed: DataFrame, by: list[str], first: int = 5, most: int = 6, size: int = 800) -> DataFrame:
    """Statements that cite what their domain may cite: (by, domain, kind, n, statement, evidence_ids).

    ``statements``: by, domain, kind, n, statement, evidence_ids; of each kind the ``first`` by n count. ``allowed``: by, domain,
    evidence_id. Of the ids those allowed stay, each once, ``most`` of them; a statement without text or ids goes.
    """
    key = [*by, "domain", "kind", "n"]
    x = statements.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "domain", "kind").orderBy("n"))).where(F.col("rank") <= first)
    x = x.withColumn("statement", t.squeeze(F.coalesce("statement", F.lit("")))).where("statement <> ''")
    ids = x.select(*key, F.posexplode("evidence_ids").alias("at", "evidence_id")).groupBy(*key, "evidence_id").agg(F.min("at").alias("at"))
    ids = ids.join(allowed.select(*by, "domain", "evidence_id").distinct(), [*by, "domain", "evidence_id"], "left_semi")
    kept = ids.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("at"))).where(F.col("rank") <= most)
    held = kept.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "evidence_id"))), lambda v: v["evidence_id"]).alias("evidence_ids"))
    return x.select(*key, F.left("statement", F.lit(size)).alias("statement")).join(held, key)


def memoranda(packets: DataFrame, allowed: DataFrame, statements: DataFrame, by: list[str], domains: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(by, domain, status, evidence_count, statements) of every domain of each packet (by).

    Without evidence it is insufficient whatever was stated; with statements it is reviewed.
    """
    each = packets.select(*by, F.explode(F.array(*map(F.lit, domains or DOMAINS))).alias("domain"))
    e = allowed.groupBy(*by, "domain").agg(F.count_distinct("evidence_id").alias("evidence_count"))
    s = statements.groupBy(*by, "domain").agg(F.count(F.lit(1)).alias("n"))
    x = each.join(e, [*by, "domain"], "left").join(s, [*by, "domain"], "left")
    count = F.coalesce("evidence_count", F.lit(0))
    said = F.when(count > 0, F.coalesce("n", F.lit(0))).otherwise(F.lit(0))
    status = F.when(count == 0, "insufficient_evidence").when(said > 0, "reviewed").otherwise("no_supported_statements")
    return x.select(*by, "domain", status.alias("status"), count.alias("evidence_count"), said.alias("statements"))
