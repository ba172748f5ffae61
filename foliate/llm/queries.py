"""The registered queries of the operators, and SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.line_dedup import line_report

    return line_report(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), vocabulary())


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.ppm import score

    return score(documents(spark, sf_dir))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.shared import new_path
    from foliate.llm.token_output import token_digests, write_tokens

    path = new_path(spark, "token-ids")
    write_tokens(documents(spark, sf_dir), path, vocabulary())
    return token_digests(spark, path)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.packing import pack

    return pack(documents(spark, sf_dir), vocabulary())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.quality import CONTEXT, quality

    return quality(documents(spark, sf_dir), context=CONTEXT)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.simhash import simhash_groups

    return simhash_groups(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.decontaminate import matches

    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.pii import pii_report

    return pii_report(documents(spark, sf_dir), key="foliate")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, then language, then document.

    Of the documents with a header that matches a template, the first (smallest
    id) of each source is the source's licence file, and of the rest the first
    of each source and language is that directory's; the others stay files.
    """
    from pyspark.sql import functions as F

    from foliate.llm.licenses import license_scan, scan
    from foliate.llm.shared import cut

    docs = documents(spark, sf_dir).withColumns({c: F.coalesce(c, F.lit("_")) for c in ("source", "lang")})
    found = cut(scan(docs.withColumn("path", F.lit(None).cast("string"))).select(F.col("id").alias("doc_id")))
    found = cut(docs.select("doc_id", "source", "lang").join(found, "doc_id", "left_semi"))
    top = cut(found.groupBy("source").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit("source").alias("of")))
    low = found.join(top, "doc_id", "left_anti").groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit("lang").alias("of"))
    name = F.concat(F.when(F.col("of").isNotNull(), "LICENSE.").otherwise(""), F.col("doc_id").cast("string"))
    path = F.concat_ws("/", "source", F.when(F.col("of").eqNullSafe("source"), None).otherwise(F.col("lang")), name)
    return license_scan(docs.join(cut(top.union(low)), "doc_id", "left").select("doc_id", path.alias("path"), "text"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.variants import spelling_variants

    return spelling_variants(documents(spark, sf_dir), drop_one_in=97)


#: CRC-32 of a list of bytes: the table of its 256 steps comes from the polynomial.
CRC_SQL = """
crc_table as (select list(v order by i) steps from (select i, list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda x: 0::ubigint)),
    lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) v from (select unnest(range(256)) i)))"""
CRC_OF = "xor(list_reduce(list_prepend(4294967295::ubigint, {bytes}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255)::bigint + 1])), 4294967295::ubigint)"

OP11_SQL = r"""
with recursive """ + CRC_SQL + r""",
runs as (select id, run, count(*) n from (select doc_id::varchar id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) run from documents) group by all),
bytes as (select run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: case when ord(c) < 128 then [ord(c)::ubigint] else [195::ubigint, (ord(c) - 64)::ubigint] end)) b from runs),
hashed as (select run, n, """ + CRC_OF.format(bytes="b") + r""" h from bytes, crc_table),
spelled as (select case when h % 97 = 0 then run[1:(h % length(run))::int] || run[(h % length(run))::int + 2:] else run end word, n from hashed),
words as (select word, sum(n)::bigint n from spelled where length(word) >= 5 group by 1 having sum(n) >= 3),
less as (select word, n, i, word[1:i - 1] || word[i + 1:] rest from (select word, n, unnest(range(1, length(word) + 1)) i from words)),
near as (select a.word, b.word other, b.n from less a join less b on a.i = b.i and a.rest = b.rest and length(a.word) = length(b.word) and a.word <> b.word
    union select less.word, b.word, b.n from less join words b on less.rest = b.word
    union select b.word, less.word, less.n from less join words b on less.rest = b.word),
best as (select word, count(*) n_near, first(other order by n desc, other) form, max(n) form_n from near group by 1),
formed as (select word, w.n, coalesce(n_near, 0) n_near, case when form_n >= 2 * w.n then form end form, case when form_n >= 2 * w.n then form_n end form_n from words w left join best using (word)),
chain as (select word, form top, 1 k from formed where form is not null union all select c.word, f.form, k + 1 from chain c join formed f on c.top = f.word where f.form is not null),
roots as (select word, arg_max(top, k) root from chain group by 1)
select word, form, coalesce(root, word) root, n, n_near, form_n from formed left join roots using (word)
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.conversations import conversation_trie

    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = """
with recursive """ + CRC_SQL + """,
turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 pos, coalesce(role, '') role, coalesce(text, '') txt from conversations where conv_id is not null),
convs as (select conv_id, """ + CRC_OF.format(bytes="list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::ubigint)") + """ % 9 h, conv_id - conv_id % 5 base from (select distinct conv_id from turns), crc_table),
kept as (select c.*, (select count(*) from turns t where t.conv_id = c.base and t.pos < c.h) n from convs c),
rebuilt as (select c.conv_id, t.pos + 1 depth, role, txt from kept c join turns t on t.conv_id = c.base and t.pos < c.h
    union all select c.conv_id, t.pos - c.h + c.n + 1, role, txt from kept c join turns t on t.conv_id = c.conv_id and t.pos >= c.h),
full_path as (select k.conv_id, coalesce(list({'r': role, 't': txt} order by depth) filter (depth is not null), []) turns from kept k left join rebuilt using (conv_id) group by 1),
steps as (select conv_id, unnest(range(0, len(turns) + 1)) depth, turns from full_path),
prefixed as (select conv_id, depth, len(turns) n, turns[1:depth] path from steps),
nodes as (select path, depth, min(conv_id) owner, count(*) n_convs, (n_convs - 1) * case when depth > 0 then strlen(path[depth].t) else 0 end saved,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '')) ends_sha256 from prefixed group by path, depth),
sub as (select unnest(range(0, depth + 1)) d, path, saved, not exists (select 1 from nodes c where c.depth = nodes.depth + 1 and c.path[1:nodes.depth] = nodes.path) leaf from nodes),
sums as (select path[1:d] path, sum(saved)::bigint saved_tokens, count(*) filter (leaf) n_leaves from sub group by 1),
kids as (select path[1:depth - 1] path, count(*) n_children from nodes where depth > 0 group by 1)
select n.owner conv_id, n.depth, p.owner parent_conv_id, n.n_convs, coalesce(n_children, 0) n_children, n_leaves, saved_tokens, n.ends_sha256
from nodes n join sums using (path) left join kids using (path) left join nodes p on n.depth > 0 and p.depth = n.depth - 1 and p.path = n.path[1:n.depth - 1]
"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from foliate.llm.substrings import drop_repeats

    return drop_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 33)) i from t where len(w) >= 35),
windows as (select doc_id, i, array_to_string(w[i:i + 34], ' ') win from starts),
twice as (select win from windows group by win having count(*) > 1),
gone as (select distinct doc_id, i + k j from windows join twice using (win), (select unnest(range(35)) k)),
words as (select doc_id, unnest(w) word, generate_subscripts(w, 1) j from t),
kept as (select doc_id, string_agg(word, ' ' order by j) txt, count(*) n from words anti join gone using (doc_id, j) group by doc_id)
select doc_id, len(w)::bigint n_words, len(w)::bigint - coalesce(n, 0) n_removed, sha256(coalesce(txt, '')) kept_sha256
from t left join kept using (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_quality, op4_simhash, op5_lm_scoring, op6_token_output, op7_packing, op8_decontamination, op9_pii, op10_licenses, op11_spelling_variants, op12_conversation_trie, op13_substring_dedup)}
ORACLE: dict[str, str] = {"op11_spelling_variants": OP11_SQL, "op12_conversation_trie": OP12_SQL, "op13_substring_dedup": OP13_SQL}
