"""Registered queries of trees, budgets, drafts and their correction, recognition, packets and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions import labels
from foliate.functions import text as t
from foliate.operators import access, audit, chunks, dossier, drafts, evidence, extraction, packets, reports, sections, summaries, tree, verification
from foliate.plans.registry import query, table

c = F.col


@query("""WITH RECURSIVE n AS (SELECT max(doc_id) AS most FROM documents), items AS (SELECT doc_id AS id, CASE WHEN doc_id > 0 THEN (doc_id - 1) // 6 END AS parent, coalesce(source, 'x') || ' ' || doc_id AS name, doc_id * 6 + 1 <= most AS folder, n_chars, doc_id % 50 = 49 AS output FROM documents, n),
walk AS (SELECT id, name AS path, 0 AS depth FROM items WHERE id = 0 UNION ALL SELECT i.id, path || '/' || i.name, depth + 1 FROM walk JOIN items i ON i.parent = walk.id WHERE folder AND NOT output)
SELECT i.id::VARCHAR AS file_id, path || '/' || i.name AS path, depth, n_chars FROM walk JOIN items i ON i.parent = walk.id WHERE NOT folder AND NOT output""")
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO14: documents as items of a tree in which each of the first has six children."""
    docs = table(spark, sf_dir, "documents")
    key = c("doc_id")
    most = docs.agg(F.max("doc_id").alias("most"))
    items = docs.join(F.broadcast(most)).select(  # one row
        key.cast("string").alias("id"), F.when(key > 0, F.expr("(doc_id - 1) div 6").cast("string")).alias("parent_id"), F.concat(F.coalesce("source", F.lit("x")), F.lit(" "), key.cast("string")).alias("name"),
        (key * 6 + 1 <= c("most")).alias("is_folder"), (key % 50 == 49).alias("is_output"), "n_chars",
    )
    return tree.folder_tree(items, "0")


# Packets of the next queries: orders as entries, and what stands for their registers.
PACKET_SQL = """e AS (SELECT o_custkey % 200 AS packet, o_orderkey AS place, o_orderpriority AS register, o_orderstatus <> 'P' AS removable, (o_orderkey % 11) / 10 AS confidence, o_orderkey % 4 AS corroboration, 20 + o_orderkey % 60 AS size, [o_orderkey % 30 + i FOR i IN range(o_orderkey % 5)] AS sources FROM orders),
total AS (SELECT packet, 400 + packet % 10 * 200 AS budget, 100 + sum(size + coalesce(list_sum(sources), 0)) AS total, sum(greatest(0, len(sources) - 1)) AS spare FROM e GROUP BY packet),
large AS (SELECT * FROM total WHERE greatest(1, total // 3) > budget),
lists AS (SELECT packet, place, i, sources[i] AS s FROM (SELECT packet, place, sources, unnest(range(2, len(sources) + 1)) AS i FROM e)),
pops AS (SELECT *, row_number() OVER w AS step, coalesce(sum(s) OVER (PARTITION BY packet ORDER BY i DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lists WINDOW w AS (PARTITION BY packet ORDER BY i DESC, place)),
popped AS (SELECT p.* FROM pops p JOIN large USING (packet) WHERE step <= 300 AND greatest(1, (total - before) // 3) > budget),
lost AS (SELECT packet, place, count(*) AS lost FROM popped GROUP BY ALL),
second AS (SELECT packet, budget, total - coalesce(sum(s), 0) AS remaining, count(s) AS taken FROM large LEFT JOIN popped USING (packet) GROUP BY packet, budget, total, spare HAVING count(s) = spare),
ranked AS (SELECT *, row_number() OVER (PARTITION BY packet, register ORDER BY confidence, corroboration, place) AS rank, count(*) OVER (PARTITION BY packet, register) AS n FROM e WHERE removable),
steps AS (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY confidence, corroboration, place) AS step, coalesce(sum(size + coalesce(sources[1], 0)) OVER (PARTITION BY packet ORDER BY confidence, corroboration, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked WHERE rank <= n - CASE register WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 0 ELSE 1 END),
removed AS (SELECT packet, place FROM steps JOIN second USING (packet) WHERE step <= 300 - taken AND greatest(1, (remaining - before) // 3) > budget)"""


@query(f"""WITH {PACKET_SQL} SELECT packet, place, len(sources) - coalesce(lost, 0) AS n_sources FROM e LEFT JOIN lost USING (packet, place) WHERE (packet, place) NOT IN (SELECT (packet, place) FROM removed)""")
def shrunk_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of packets, shrunk to budgets within which lists, floors and the number of steps bind."""
    key = c("o_orderkey")
    entries = table(spark, sf_dir, "orders").select(
        (c("o_custkey") % 200).alias("packet"), key.alias("place"), c("o_orderpriority").alias("register"), (c("o_orderstatus") != "P").alias("removable"), (key % 11 / 10).alias("confidence"), (key % 4).cast("int").alias("corroboration"),
        (20 + key % 60).cast("int").alias("size"), F.transform(F.sequence(F.lit(0).cast("long"), key % 5), lambda i: (key % 30 + i).cast("int")).alias("sources"),
    ).withColumn("sources", F.slice("sources", F.lit(1), F.size("sources") - 1))
    heads = entries.select("packet").distinct().select("packet", (400 + c("packet") % 10 * 200).alias("budget"), F.lit(100).alias("fixed"))
    return packets.shrunk(heads, entries, ["packet"], {"1-URGENT": 4, "2-HIGH": 0}).select("packet", "place", F.size("sources").cast("long").alias("n_sources"))


REGISTERS = list(packets.FLOORS)
DOMAIN_ROWS = ", ".join(f"('{d}', '{r}')" for d, rs in packets.DOMAINS.items() for r in rs)


@query(f"""WITH regs AS (SELECT {REGISTERS} AS names), d(domain, register) AS (VALUES {DOMAIN_ROWS}), doms AS (SELECT {list(packets.DOMAINS)} AS names),
e AS (SELECT packet, register, field, register || ':' || n AS id FROM (SELECT p_size AS packet, names[p_partkey % 9 + 1] AS register, p_brand AS field, p_partkey AS n, row_number() OVER (PARTITION BY p_size, p_partkey % 9 ORDER BY p_partkey) AS place FROM part, regs) WHERE place <= 24),
k AS (SELECT s_suppkey % 50 + 1 AS packet, 'conflict:' || s_suppkey AS id, 'Brand#' || (s_suppkey % 60) AS field FROM supplier),
own AS (SELECT packet, domain, id, field FROM e JOIN d USING (register)), met AS (SELECT DISTINCT k.packet, domain, k.id FROM k JOIN own USING (packet, field)),
may AS (SELECT packet, domain, id FROM own UNION ALL SELECT * FROM met UNION ALL SELECT packet, unnest(names), id FROM k, doms WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.packet = k.packet AND met.id = k.id)),
s AS (SELECT packet, domain, kind, n, unnest(ids) AS id FROM (SELECT c_custkey % 50 + 1 AS packet, dn.names[c_custkey // 50 % 6 + 1] AS domain, c_mktsegment AS kind, c_custkey AS n, c_name, [r.names[c_custkey % 9 + 1] || ':' || c_custkey, r.names[c_custkey % 9 + 1] || ':' || (c_custkey + 45), 'conflict:' || (c_custkey % 7)] AS ids, row_number() OVER (PARTITION BY c_custkey % 50, c_custkey // 50 % 6, c_mktsegment ORDER BY c_custkey) AS rank FROM customer, regs r, doms dn) WHERE rank <= 5 AND c_name <> ''),
kept AS (SELECT packet, domain, count(*) AS said FROM (SELECT DISTINCT packet, domain, kind, n FROM s WHERE EXISTS (SELECT 1 FROM may WHERE may.packet = s.packet AND may.domain = s.domain AND may.id = s.id)) GROUP BY ALL),
every AS (SELECT packet, unnest(names) AS domain FROM (SELECT DISTINCT p_size AS packet FROM part), doms), n AS (SELECT packet, domain, count(DISTINCT id) AS evidence_count FROM may GROUP BY ALL)
SELECT packet, domain, CASE WHEN coalesce(evidence_count, 0) = 0 THEN 'insufficient_evidence' WHEN said > 0 THEN 'reviewed' ELSE 'no_supported_statements' END AS status, coalesce(evidence_count, 0) AS evidence_count, CASE WHEN evidence_count > 0 THEN coalesce(said, 0) ELSE 0 END AS statements FROM every LEFT JOIN n USING (packet, domain) LEFT JOIN kept USING (packet, domain)""")
def specialist_memoranda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries of packets, suppliers as conflicts, customers as statements that cite both."""
    key, regs = c("p_partkey"), F.array(*map(F.lit, REGISTERS))
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    entries = part.select(c("p_size").alias("packet"), F.get(regs, (key % 9).cast("int")).alias("register"), key.alias("n"), c("p_brand").alias("field"), c("p_name").alias("value"), F.lit(None).cast("string").alias("normalized"))
    sup = c("s_suppkey")
    concerns = table(spark, sf_dir, "supplier").select((sup % 50 + 1).alias("packet"), F.concat(F.lit("conflict:"), sup.cast("string")).alias("evidence_id"), F.lit("canonical_conflict").alias("kind"), F.concat(F.lit("Brand#"), (sup % 60).cast("string")).alias("field"), F.lit(None).cast("string").alias("code"))
    may = packets.domain_evidence(packets.packet_entries(entries, ["packet"]), concerns, ["packet"])
    cust = c("c_custkey")
    named = lambda n: F.concat(F.get(regs, (cust % 9).cast("int")), F.lit(":"), n.cast("string"))
    said = customer.select(
        (cust % 50 + 1).alias("packet"), F.get(F.array(*map(F.lit, packets.DOMAINS)), F.expr("cast(c_custkey div 50 % 6 as int)")).alias("domain"), c("c_mktsegment").alias("kind"), cust.alias("n"), c("c_name").alias("statement"),
        F.array(named(cust), named(cust + 45), F.concat(F.lit("conflict:"), (cust % 7).cast("string"))).alias("evidence_ids"),
    )
    kept = packets.allowed_statements(said, may, ["packet"])
    return packets.memoranda(part.select(c("p_size").alias("packet")).distinct(), may, kept, ["packet"])


# Drafts of the next queries: each document is a section and a claim, and its first words are values that its draft holds.
SAID = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"
DRAFT_SQL = f"""d AS (SELECT doc_id AS draft_id, coalesce(text, '') AS body, coalesce(source, '') AS source, 'Akt ' || coalesce(lang, '') AS title FROM documents),
shown AS (SELECT draft_id, {SAID.format("concat_ws(chr(10), title, '', '', 'T', body)")} AS said FROM d),
asks AS (SELECT draft_id, k, value, {SAID.format("value")} AS v FROM (SELECT draft_id, unnest(['fact', 'selected', 'other', 'detail']) AS k, unnest([left(body, 40), source || ' zona ' || draft_id, left(body, 12), 'detaj ' || source || ' ' || draft_id]) AS value FROM d)),
tokens AS (SELECT *, list_filter(string_split(v, ' '), lambda w: length(w) >= 3 AND w NOT IN ('bashkia', 'date', 'dat', 'fshati', 'kol', 'leje', 'ndertimi', 'nr', 'prot', 'rep', 'shpk')) AS words, list_distinct(regexp_extract_all(v, '[0-9]+')) AS numbers FROM asks),
present AS (SELECT draft_id, k, value, v <> '' AND (contains(said, v) OR (len(numbers) >= 2 AND len(list_filter(numbers, lambda n: NOT list_contains(regexp_extract_all(said, '[0-9]+'), n))) = 0) OR (len(words) > 0 AND len(list_filter(words, lambda w: contains(said, w))) >= least(3, len(words)))) AS there FROM tokens JOIN shown USING (draft_id)),
has AS (SELECT draft_id, bool_or(there) FILTER (k = 'fact') AS fact, bool_or(there) FILTER (k = 'selected') AS chosen, bool_or(there) FILTER (k = 'other') AS other, bool_or(there) FILTER (k = 'detail') AS detail, max(value) FILTER (k = 'fact') AS fact_value, max(value) FILTER (k = 'selected') AS selected, max(value) FILTER (k = 'other') AS alternative, max(value) FILTER (k = 'detail') AS detail_value FROM present GROUP BY draft_id)"""


def document_drafts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents as drafts of one section and one claim, with facts, conflicts and details about them."""
    docs = table(spark, sf_dir, "documents")
    key, body, source = c("doc_id").alias("draft_id"), F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))
    none = F.lit(None).cast("string")
    claim = F.struct(F.lit("c0"), F.lit("s"), body, F.lit("documented_fact"), F.lit("proven"), F.array(F.lit("e")), F.lit(0.5)).cast(drafts.CLAIM)
    d = docs.select(key, F.concat(F.lit("Akt "), F.coalesce("lang", F.lit(""))).alias("title"), F.lit("").alias("summary"), none.alias("signature"), F.array(F.struct(F.lit("s"), F.lit("T"), body).cast(drafts.SECTION)).alias("sections"), F.array(claim).alias("ledger"))
    facts = docs.select(key, F.lit("object_name").alias("field"), F.left(body, F.lit(40)).alias("value"))
    number = c("doc_id").cast("string")
    conflicts = docs.select(key, F.lit(0).alias("n"), F.when(c("doc_id") % 2 == 0, "location").otherwise("roof").alias("field"), F.concat(source, F.lit(" zona "), number).alias("selected"), F.array(F.left(body, F.lit(12))).alias("alternatives"), *[F.lit(None).cast("array<string>").alias(x) for x in ("sources", "other_sources")])
    details = docs.select(key, F.lit(0).alias("n"), F.lit("steel_grade").alias("field"), F.lit("project_parameters").alias("register"), F.concat(F.lit("detaj "), source, F.lit(" "), number).alias("value"), F.lit("e:1").alias("evidence_id"), F.lit(True).alias("must_include"), F.lit(None).cast("array<string>").alias("sources"))
    return d, facts, conflicts, details


@query(f"""WITH {DRAFT_SQL} SELECT draft_id, 'PUBLIC-CANONICAL-FACT-OMITTED' AS code, 'minor' AS severity FROM has WHERE NOT fact AND trim(fact_value) <> ''
UNION ALL SELECT draft_id, 'PUBLIC-CONFLICT-ALTERNATIVE-USED', CASE WHEN draft_id % 2 = 0 THEN 'major' ELSE 'minor' END FROM has WHERE other AND NOT chosen
UNION ALL SELECT draft_id, 'PUBLIC-DETAIL-MISSING', 'major' FROM has WHERE NOT detail""")
def draft_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, conflicts and details of drafts against their texts."""
    d, facts, conflicts, details = document_drafts(spark, sf_dir)
    found = drafts.fact_issues(d, facts).unionByName(drafts.conflict_issues(d, conflicts, facts)).unionByName(drafts.detail_issues(d, details))
    return found.select("draft_id", "code", "severity")


@query(f"""WITH {DRAFT_SQL}, e AS (SELECT d.draft_id, body, detail, CASE WHEN other AND NOT chosen AND d.draft_id % 2 = 0 AND trim(alternative, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN replace(body, trim(alternative, ' ' || chr(9) || chr(10) || chr(13)), selected) ELSE body END AS after FROM d JOIN has USING (draft_id))
SELECT draft_id, md5(after) AS body, CASE WHEN detail THEN 1 ELSE 2 END AS n_sections, CASE WHEN detail THEN 1 ELSE 2 END AS n_claims FROM e""")
def corrected_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts in which other values are replaced by the selected ones and missing details are added, as their issues ask."""
    d, facts, conflicts, details = document_drafts(spark, sf_dir)
    issues = drafts.conflict_issues(d, conflicts, facts).unionByName(drafts.detail_issues(d, details))
    after = drafts.corrected(d, issues)
    return after.select("draft_id", F.md5(F.get("sections", F.lit(0))["body"]).alias("body"), F.size("sections").alias("n_sections"), F.size("ledger").alias("n_claims"))


FACT_NAMES = sorted({f for _, facts, *_ in sections.SECTIONS.values() for f in facts})
FILE_SECTIONS = sorted({e for _, _, es, *_ in sections.SECTIONS.values() for e in es})
PLAN_SQL = ", ".join(f"({n}, '{code}', '{kind}', {i}, '{name}')" for n, (code, (_, *lists)) in enumerate(sections.SECTIONS.items()) for kind, names in zip(("fact", "evidence", "register", "domain"), lists, strict=True) for i, name in enumerate(names))
CODE_SQL = ", ".join(f"({n}, '{code}')" for n, code in enumerate(sections.SECTIONS))


@query(f"""WITH plan(n, code, kind, place, name) AS (VALUES {PLAN_SQL}), codes(n, code) AS (VALUES {CODE_SQL}), p AS (SELECT c_custkey AS project, c_nationkey FROM customer),
f AS (SELECT DISTINCT o_custkey AS project, {FACT_NAMES}[o_orderkey % {len(FACT_NAMES)} + 1] AS name FROM orders WHERE o_orderstatus <> 'P'), files AS (SELECT DISTINCT o_custkey AS project, {FILE_SECTIONS}[o_orderkey % {len(FILE_SECTIONS)} + 1] AS name, o_orderpriority AS file FROM orders),
r AS (SELECT o_custkey AS project, {REGISTERS}[o_orderkey % 9 + 1] AS name, count(*) AS k FROM orders GROUP BY ALL), m AS (SELECT project, {list(packets.DOMAINS)}[project % 6 + 1] AS name, 'reviewed:' || c_nationkey AS told FROM p)
SELECT project, codes.n, codes.code,
coalesce((SELECT string_agg(x.name, ',' ORDER BY place) FROM plan x WHERE x.n = codes.n AND kind = 'fact' AND EXISTS (SELECT 1 FROM f WHERE f.project = p.project AND f.name = x.name)), '') AS available,
coalesce((SELECT string_agg(x.name, ',' ORDER BY place) FROM plan x WHERE x.n = codes.n AND kind = 'fact' AND NOT EXISTS (SELECT 1 FROM f WHERE f.project = p.project AND f.name = x.name)), '') AS missing,
coalesce((SELECT string_agg(file, ',' ORDER BY file) FROM (SELECT DISTINCT file FROM plan x JOIN files USING (name) WHERE x.n = codes.n AND kind = 'evidence' AND files.project = p.project)), '') AS files,
(SELECT string_agg(x.name || ':' || coalesce(k, 0), ',' ORDER BY place) FROM plan x LEFT JOIN r ON r.project = p.project AND r.name = x.name WHERE x.n = codes.n AND kind = 'register') AS entries,
coalesce((SELECT string_agg(x.name || ':' || told, ',' ORDER BY place) FROM plan x JOIN m ON m.name = x.name WHERE x.n = codes.n AND kind = 'domain' AND m.project = p.project), '') AS reviews FROM p, codes""")
def section_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as projects, whose orders are facts, files and entries."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, project = c("o_orderkey"), c("o_custkey").alias("project")
    one_of = lambda names: F.get(F.array(*map(F.lit, names)), (key % len(names)).cast("int"))
    facts = orders.select(project, one_of(FACT_NAMES).alias("field"), F.when(c("o_orderstatus") != "P", "x").alias("value"))
    files = orders.select(project, one_of(FILE_SECTIONS).alias("section"), c("o_orderpriority").alias("filename"))
    entries = orders.select(project, one_of(REGISTERS).alias("register"))
    memo = customer.select(c("c_custkey").alias("project"), F.get(F.array(*map(F.lit, packets.DOMAINS)), (c("c_custkey") % 6).cast("int")).alias("domain"), F.lit("reviewed").alias("status"), c("c_nationkey").alias("statements"))
    x = sections.section_plan(customer.select(c("c_custkey").alias("project")), facts, files, entries, memo, ["project"])
    listed = lambda name, f: F.array_join(F.transform(name, f), ",").alias(name)
    return x.select("project", "n", "code", *[F.array_join(v, ",").alias(v) for v in ("available", "missing", "files")], listed("entries", lambda e: F.concat_ws(":", e["register"], e["n"])), listed("reviews", lambda r: F.concat_ws(":", r["domain"], r["status"], r["statements"])))


@query("""WITH w AS (SELECT doc_id, (doc_id * 7 + n * 13) % 101 AS conf, w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS n FROM documents WHERE text IS NOT NULL)),
x AS (SELECT doc_id, conf, trim(regexp_replace(w, '\\s+', ' ', 'g')) AS w FROM w), pages AS (SELECT DISTINCT doc_id FROM x)
SELECT doc_id, count(*) FILTER (w <> '' AND conf >= 30) AS accepted, count(*) FILTER (w <> '' AND conf < 30) AS rejected, (doc_id % 3 + 1)::INT AS width FROM x GROUP BY doc_id""")
def recognised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recognised pages, words below a confidence rejected."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    zero, none = F.lit(0), F.lit(None).cast("string")
    words = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "text")).withColumn("word_num", c("i") + 1)
    places = [F.lit(5).alias("level"), *[zero.alias(x) for x in ("block_num", "par_num", "line_num")], "word_num", (c("word_num") * 10).alias("left"), zero.alias("top"), zero.alias("width"), zero.alias("height")]
    rows = words.select("doc_id", *places, ((c("doc_id") * 7 + c("word_num") * 13) % 101).cast("double").alias("conf"), "text")
    heads = docs.select("doc_id", F.lit(1).alias("level"), *[zero.alias(x) for x in ("block_num", "par_num", "line_num", "word_num", "left", "top")], (c("doc_id") % 3 + 1).cast("int").alias("width"), zero.alias("height"), F.lit(-1.0).alias("conf"), none.alias("text"))
    return chunks.recognised_pages(rows.unionByName(heads), ["doc_id"], 30).select("doc_id", "accepted", "rejected", "width")


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN json_extract_string(props, '$.k') END AS k FROM events""")
def reply_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S51 and S52 on VARIANT: replies that are an object, hold one in a fence, are a list of one, or hold braces that are none before it."""
    key = c("event_id") % 4
    said = F.when(key == 0, c("props")).when(key == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(key == 2, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.concat(F.lit("x {no} y "), "props"))
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(labels.json_value(said), "$.k", "string").alias("k"))


@query("""WITH d AS (SELECT doc_id, source, lang, doc_id % 3 AS k, lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || '.05.2020' AS day, lpad(doc_id::VARCHAR, 9, '0') AS file FROM documents WHERE text IS NOT NULL),
c(field, value, e, step, line_no, n, file, k) AS (
SELECT 'investor', 'Firma ' || coalesce(source, 'x'), 0.93, 0, 0, 2, file, k FROM d
UNION ALL SELECT 'construction_permit_number', 'Nr. ' || (doc_id % 50) || '/A', 0.97, 0, 1, 0, file, k FROM d WHERE k <> 2
UNION ALL SELECT 'construction_permit_date', day, 0.95, 0, 1, 1, file, k FROM d WHERE k <> 2
UNION ALL SELECT 'total_construction_area', (100 + doc_id % 7) || '.5 m²', 0.93, 0, 2, 0, file, k FROM d
UNION ALL SELECT 'basement_area', '40 m²', 0.92, 0, 2, 1, file, k FROM d
UNION ALL SELECT 'contractor', 'Beta ' || coalesce(lang, 'x'), 0.91, 1, 0, 0, file, k FROM d WHERE k = 2
UNION ALL SELECT 'contractor_contract_reference', 'Nr. Rep. ' || (doc_id % 20) || ', Nr. Kol. 7, datë 01.02.2021', 0.92, 1, 0, 1, file, k FROM d WHERE k = 2
UNION ALL SELECT 'designer', 'Studio ' || (doc_id % 4), 0.8, 5, 0, 0, file, k FROM d WHERE doc_id % 5 = 0),
a AS (SELECT *, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.62 ELSE 0.92 END AS authority FROM c),
g AS (SELECT field, value, max(authority) AS authority, max(e) AS e, count(DISTINCT file) AS sources, min(file || '-' || step || '-' || line_no || '-' || n) AS first_seq FROM a GROUP BY field, value),
s AS (SELECT *, round(least(0.99, 0.62 * authority + 0.23 * e + 0.10 * 0.55 + least(0.15, 0.05 * (sources - 1)) + CASE WHEN field LIKE 'construction_permit%' AND authority >= 0.9 THEN 0.04 ELSE 0 END), 3) AS score FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, sources DESC, first_seq) AS rank FROM s)
SELECT field, max(value) FILTER (rank = 1) AS value, max(score) FILTER (rank = 1)::DOUBLE AS score, max(sources) FILTER (rank = 1) AS sources, coalesce(string_agg(value, '|' ORDER BY rank) FILTER (rank BETWEEN 2 AND 4), '') AS alternatives FROM r GROUP BY field""")
def dossier_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 to K9, A7 and A8 from texts to canonical facts: documents with lines of a permit, a table and a contract before their texts, and claims about some."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    key, num = c("doc_id"), lambda x: x.cast("string")
    file = F.lpad(num(key), 9, "0")
    contract = key % 3 == 2
    head = F.concat_ws(
        "\n", F.concat(F.lit("Investitori: Firma "), F.coalesce("source", F.lit("x"))), F.concat(F.lit("Leje ndërtimi nr. "), num(key % 50), F.lit("/A, datë "), F.lpad(num(key % 28 + 1), 2, "0"), F.lit(".05.2020")),
        F.concat(F.lit("Siperfaqja e pergjithshme e ndertimit "), num(100 + key % 7), F.lit(",5 m2 dhe 40 m2 podrum")), F.when(contract, F.concat(F.lit("Nr. Rep. "), num(key % 20), F.lit(", Nr. Kol. 7, datë 01.02.2021"))), "text",
    )
    name = F.when(contract, F.concat(file, F.lit(" Kontrate sipermarresi me Beta "), F.coalesce("lang", F.lit("x")), F.lit(".pdf"))).otherwise(F.concat(file, F.lit(".pdf")))
    kind = F.when(contract, "contract_and_related_acts").when(key % 3 == 0, "construction_permit").otherwise("letter")
    d = docs.select(key.alias("version_id"), name.alias("filename"), kind.alias("kind"), F.lit(None).cast("double").alias("classification"), F.lit(True).alias("parsed"), F.lit("s").alias("sha256"), head.alias("text"))
    proof = F.array(F.struct(F.lit("no").alias("excerpt"), F.lit(False).alias("verified")), F.struct(F.lit("Projektuesi").alias("excerpt"), (key % 10 == 0).alias("verified")), F.struct(F.lit("more").alias("excerpt"), F.lit(True).alias("verified")))
    analysed = docs.where("doc_id % 5 = 0").select(key.alias("version_id"), F.lit("s").alias("sha"), F.lit(0).alias("claim_no"), F.lit("Designer Name").alias("field_name"), F.concat(F.lit(" Studio  "), num(key % 4), F.lit(";")).alias("original_value"), F.lit(0.8).alias("confidence"), proof.alias("evidence"))
    x = dossier.dossier_facts(d, analysed)
    return x.select("field", "value", "score", "sources", F.array_join(F.transform("alternatives", lambda a: a["value"]), "|").alias("alternatives"))


# Prompts of K35: texts of conversations behind phrases, and the actions that each asks for.
PHRASES = ["Shfaq projektet e mia. ", "Krijo një projekt. ", "Ku ka arritur? ", "Gjenero aktin e kolaudimit: ", "Importo: ", "https://drive.google.com/x Importo, pastaj ruaje aty. ", "Kush është sipërmarrësi? "]
ASKED = ["list_projects", "create_project", "get_status", "estimate_kolaudim,generate_kolaudim", "import_attachment", "import_drive_folder,upload_report_to_drive", "answer_project_question"]


@query(f"""SELECT conv_id, turn, CASE WHEN conv_id % 7 = 4 AND turn % 2 = 0 THEN '' ELSE {ASKED}[conv_id % 7 + 1] END AS actions FROM conversations WHERE conv_id % 7 <> 5 OR turn % 2 = 0""")
def prompt_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as prompts; every second one has an attachment (without one, an import of it is not asked for)."""
    conv = table(spark, sf_dir, "conversations").where("conv_id % 7 <> 5 or turn % 2 = 0")
    prompt = F.concat(F.get(F.array(*map(F.lit, PHRASES)), (c("conv_id") % 7).cast("int")), F.coalesce("text", F.lit("")))
    return conv.select("conv_id", "turn", F.array_join(reports.intent_hints(prompt, c("turn") % 2 == 1), ",").alias("actions"))


@query("""WITH f AS (SELECT o_custkey % 100 AS r, CASE WHEN o_orderpriority = '1-URGENT' AND o_custkey % 3 = 0 THEN 'critical' WHEN o_orderstatus = 'F' THEN 'major' ELSE 'minor' END AS severity, o_orderpriority AS rule, o_orderkey AS created_at, CASE WHEN o_orderstatus <> 'P' THEN 'do ' || o_orderpriority END AS act FROM orders),
p AS (SELECT r, created_at, row_number() OVER (PARTITION BY r ORDER BY severity, rule, created_at) AS place FROM f)
SELECT r, count(*) AS n, CASE WHEN bool_or(severity = 'critical') THEN 'Kërkohet shqyrtim njerëzor' ELSE 'Kërkohet plotësim dokumentacioni' END AS recommendation, coalesce(string_agg(DISTINCT act, ',' ORDER BY act), '') AS actions, (SELECT sum(place * (created_at % 1000)) FROM p WHERE p.r = f.r)::BIGINT AS places FROM f GROUP BY r""")
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings of a hundred reports, their order, recommendation and required actions."""
    priority = c("o_orderpriority")
    severity = F.when((priority == "1-URGENT") & (c("o_custkey") % 3 == 0), "critical").when(c("o_orderstatus") == "F", "major").otherwise("minor")
    found = table(spark, sf_dir, "orders").select((c("o_custkey") % 100).alias("r"), severity.alias("severity"), priority.alias("rule"), c("o_orderkey").alias("created_at"), F.when(c("o_orderstatus") != "P", F.concat(F.lit("do "), priority)).alias("required_action"))
    places = reports.ordered_findings(found, ["r"]).groupBy("r").agg(F.sum(c("place") * (c("created_at") % 1000)).alias("places"))
    return reports.report_parts(found, ["r"]).join(places, "r").select("r", "n", "recommendation", F.array_join("required_actions", ",").alias("actions"), "places")


@query("""WITH r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '{"stage": "' || p_type || '"}' WHEN 2 THEN '{"stage": ["x", "' || p_brand || '"]}' WHEN 3 THEN '{"stage": ["x"]}' ELSE '{"other": 1}' END AS j, p_type, p_brand FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN true WHEN 3 THEN false WHEN 1 THEN p_type = p_brand ELSE true END AS applies FROM r""")
def rules_that_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: rules of parts as JSON: none, a word, lists, another key."""
    word = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    kind = c("p_partkey") % 5
    rule = F.when(kind == 1, F.concat(F.lit('{"stage": '), word(c("p_type")), F.lit("}"))).when(kind == 2, F.concat(F.lit('{"stage": ["x", '), word(c("p_brand")), F.lit("]}"))).when(kind == 3, F.lit('{"stage": ["x"]}')).when(kind == 4, F.lit('{"other": 1}'))
    return table(spark, sf_dir, "part").select("p_partkey", audit.applies_to(rule, "stage", c("p_brand")).alias("applies"))


@query("""SELECT o_orderpriority AS register, count(*) AS entries, count(DISTINCT o_custkey) AS documents, count(DISTINCT o_clerk) AS chunks, count(DISTINCT o_orderstatus) AS fields FROM (SELECT *, o_custkey % 50 AS o_clerk FROM orders) GROUP BY 1 UNION ALL SELECT 'none', 0, 0, 0, 0""")
def register_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of registers, one of which has none."""
    e = table(spark, sf_dir, "orders").select(c("o_orderpriority").alias("register"), c("o_orderstatus").alias("field"), c("o_custkey").alias("document"), (c("o_custkey") % 50).alias("chunk"))
    return audit.register_coverage(e, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "none"])


@query("""SELECT o_orderkey, c_nationkey AS project_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) AND o_orderstatus IN ('F', 'O') AND (o_orderpriority = '1-URGENT' OR o_orderdate::DATE > DATE '1996-01-01')""")
def member_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of customers' files, of projects that have members, of some states, that have not run out."""
    files = table(spark, sf_dir, "customer").select(c("c_custkey").alias("file_id"), c("c_nationkey").alias("project_id"))
    until = F.when(c("o_orderpriority") != "1-URGENT", c("o_orderdate").cast("date"))
    versions = table(spark, sf_dir, "orders").select("o_orderkey", c("o_custkey").alias("file_id"), "o_orderstatus", until.alias("until"))
    members = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(c("s_nationkey").alias("project_id"), "s_suppkey")
    x = access.of_members(access.project_of(access.among(versions, "o_orderstatus", ["F", "O"]), files), members, "project_id")
    return access.not_expired(x, "until", F.lit("1996-01-01").cast("date")).select("o_orderkey", "project_id")


@query("""SELECT c_custkey, coalesce(string_agg(o_orderpriority || ':' || o_orderkey, ',' ORDER BY o_orderpriority, o_orderkey), '') AS parts FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def owners_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders as an array in order, empty without any."""
    parts = table(spark, sf_dir, "orders").select(c("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderkey")
    x = access.with_parts(table(spark, sf_dir, "customer").select("c_custkey"), parts, "c_custkey", ["o_orderpriority", "o_orderkey"])
    return x.select("c_custkey", F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["o_orderpriority"], p["o_orderkey"])), ",").alias("parts"))


@query("""WITH d AS (SELECT source, doc_id, ['parsed', 'failed', 'needs_ocr'][doc_id % 3 + 1] AS status, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE lang END AS kind FROM documents)
SELECT source, count(*) AS documents, count(*) FILTER (status = 'parsed') AS parsed, count(*) FILTER (status = 'parsed' AND kind = 'unknown') AS unknown, count(DISTINCT kind) AS kinds, coalesce(min(doc_id) FILTER (status = 'failed'), -1) AS first_failed, greatest(0, 7 - count(*)) AS missing FROM d WHERE source IS NOT NULL GROUP BY source""")
def parse_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of sources by status, seven expected of each."""
    status = F.get(F.array(*map(F.lit, ("parsed", "failed", "needs_ocr"))), (c("doc_id") % 3).cast("int"))
    d = table(spark, sf_dir, "documents").where("source is not null").select("source", "doc_id", status.alias("status"), F.when(c("doc_id") % 4 == 0, "unknown").otherwise(c("lang")).alias("kind"))
    expected = d.select("source").distinct().withColumn("n", F.lit(7))
    found = summaries.parse_summary(d, expected, "source", "status", "doc_id").select("source", F.coalesce(F.get(c("names")["failed"], F.lit(0)), F.lit(-1)).alias("first_failed"), "missing")
    return summaries.inventory(d, ["source"], c("status") == "parsed", "kind").join(found, "source")


@query("""WITH f AS (SELECT p_brand, p_partkey, ['zz', 'element_x', 'contract_reference_y', 'owner'][p_partkey % 4 + 1] AS field, 'v' || (p_partkey % 900) AS value FROM part), s AS (SELECT *, CASE field WHEN 'zz' THEN 'supporting_facts' WHEN 'element_x' THEN 'work_stages' ELSE 'contract_references' END AS scope, row_number() OVER (PARTITION BY p_brand, field, value ORDER BY p_partkey) AS first FROM f WHERE field <> 'owner'),
r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY field, p_partkey) AS rank FROM s WHERE first = 1) SELECT scope, p_partkey, rank FROM r WHERE rank <= CASE scope WHEN 'supporting_facts' THEN 80 ELSE 60 END""")
def scoped_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as facts of four fields, one of which is canonical."""
    key = c("p_partkey")
    field = F.get(F.array(*map(F.lit, ("zz", "element_x", "contract_reference_y", "owner"))), (key % 4).cast("int"))
    facts = table(spark, sf_dir, "part").select("p_brand", key, field.alias("field"), F.concat(F.lit("v"), (key % 900).cast("string")).alias("value"))
    return extraction.scoped_facts(facts, ["owner"], ["p_brand"], ["p_partkey"]).select("scope", "p_partkey", "rank")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey AND p_partkey % 5 = l_linenumber % 5 AND p_size % 2 = l_suppkey % 2""")
def claim_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as sources of claims, parts as chunks of the same project and version."""
    sources = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", c("l_partkey").alias("chunk_id"), (c("l_linenumber") % 5).cast("long").alias("project_id"), (c("l_suppkey") % 2).cast("long").alias("version_id"))
    held = table(spark, sf_dir, "part").select(c("p_partkey").alias("chunk_id"), (c("p_partkey") % 5).cast("long").alias("project_id"), (c("p_size") % 2).cast("long").alias("version_id"), "p_name")
    return evidence.claim_chunks(sources, held).select("l_orderkey", "l_linenumber", "l_partkey", "p_name")


@query("""SELECT conv_id, turn, array_to_string(list_filter(string_split(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9/]+', ' ', 'g')), ' '), lambda w: length(w) >= 3 AND w NOT IN ('the', 'und', 'les', 'ntion')), ' ') AS words FROM conversations WHERE text IS NOT NULL""")
def question_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of turns as questions, without stop words."""
    words = t.query_tokens(c("text"), ["the", "und", "les", "ntion"])
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.array_join(words, " ").alias("words"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, contains(lower(line), 'licen') OR contains(lower(line), 'mail') OR regexp_matches(line, '\\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}\\b') AS hit FROM l), r AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id) AS any_hit, row_number() OVER (PARTITION BY doc_id, hit ORDER BY line_no) AS rank, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS place FROM h)
SELECT doc_id, line_no::INT AS line_no FROM r WHERE CASE WHEN any_hit THEN hit AND rank <= 4 ELSE place <= 2 END""")
def schedule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a word or a date, up to four of a document; the first two of documents without any."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return chunks.schedule_lines(lines, "doc_id", ["licen", "mail"], most=4, fallback=2).select("doc_id", "line_no")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 2 ELSE 1 END AS n_lines FROM documents WHERE doc_id % 3 <> 2 AND text IS NOT NULL AND NOT regexp_matches(text, '(\\?{2,}|_{3,}|\\.{5,})') AND NOT regexp_matches(text, '(?i)\\b(xxx|todo)\\b')""")
def placeholder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with placeholders behind them, in one line or in more than the two that are told; texts that hold some themselves are left to the tests."""
    own = c("text").rlike(r"(\?{2,}|_{3,}|\.{5,})") | c("text").rlike(r"(?i)\b(xxx|todo)\b")
    more = F.when(c("doc_id") % 3 == 0, "\nDate: ____\nTODO: x\nNr. ..... \n").when(c("doc_id") % 3 == 1, "\nNr. ??\nfund").otherwise("\nfund")
    docs = table(spark, sf_dir, "documents").where(~own).select("doc_id", F.concat("text", more).alias("text"))
    return verification.placeholder_lines(docs, "text", most=2).select("doc_id", F.size("lines").alias("n_lines"))


@query("""SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def verified_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings, those of one state without evidence."""
    none = F.create_map().cast("map<string,string>")
    found = table(spark, sf_dir, "orders").select("o_custkey", F.when(c("o_orderstatus") == "F", F.create_map(F.lit("chunk"), c("o_orderpriority"))).when(c("o_orderstatus") == "O", F.create_map(F.lit("chunk"), F.lit("x"))).when(c("o_orderkey") % 2 == 0, none).alias("evidence"))
    return verification.verified_findings(found).where("evidence_verified").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS issues, count(*) FILTER (o_orderpriority = '1-URGENT') AS major, count(DISTINCT o_custkey) FILTER (o_orderpriority = '1-URGENT') AS claims, count(*) FILTER (o_orderpriority = '1-URGENT') = 0 AS publishable FROM orders""")
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues of claims."""
    return verification.summary(table(spark, sf_dir, "orders").select(c("o_custkey").alias("claim_id"), F.when(c("o_orderpriority") == "1-URGENT", "major").otherwise("minor").alias("severity")))


@query("""SELECT o_orderkey, array_to_string(list_filter([o_orderkey % 5, o_orderkey % 3, o_orderkey % 7], lambda i: i <= o_custkey % 4), ',') AS chunk_indexes, lower(o_orderstatus) || '_kind' AS category, CASE WHEN o_orderkey % 2 = 0 THEN 'other' ELSE 'x' END AS field_name, least(1.0, o_orderkey % 3)::DOUBLE AS confidence FROM orders WHERE len(list_filter([o_orderkey % 5, o_orderkey % 3, o_orderkey % 7], lambda i: i <= o_custkey % 4)) > 0""")
def batch_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims of batches, which keep the chunk indexes that their batch has."""
    orders = table(spark, sf_dir, "orders")
    key = c("o_orderkey")
    claims = orders.select(
        "o_custkey", key.alias("claim_id"), F.array(key % 5, key % 3, key % 7).alias("chunk_indexes"), F.concat(c("o_orderstatus"), F.lit("-Kind")).alias("category"), F.when(key % 2 == 0, " Other ").otherwise("x").alias("field_name"),
        F.lit("v").alias("original_value"), (key % 3).cast("double").alias("confidence"), F.lit(None).cast("string").alias("supporting_excerpt"),
    )
    allowed = orders.select("o_custkey", F.explode(F.sequence(F.lit(0).cast("long"), c("o_custkey") % 4)).alias("chunk_index")).distinct()
    x = evidence.batch_claims(claims, allowed, ["o_custkey"])
    return x.select(c("claim_id").alias("o_orderkey"), F.array_join(F.transform("chunk_indexes", lambda i: i.cast("string")), ",").alias("chunk_indexes"), "category", "field_name", "confidence")
