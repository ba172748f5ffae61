"""The training-data operators against brute force, round trips and planted cases, with edge cases in every table."""

import math
import random
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from foliate.llm.decontaminate import clean, matches
from foliate.llm.licenses import license_scan
from foliate.llm.line_dedup import dedup_lines, line_classes, line_report
from foliate.llm.packing import pack
from foliate.llm.pii import pii_report, pseudonymise
from foliate.llm.ppm import ORDER, score
from foliate.llm.quality import WIDTH, gram_counts, kneser_ney, quality
from foliate.llm.simhash import simhash_groups
from foliate.llm.stages import one_of_each_group
from foliate.llm.token_counts import token_counts
from foliate.llm.token_output import read_tokens, token_digests, write_tokens

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
KIND = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int, key string, line string, h int, block int, label array<int>"


def prose(n, seed):
    r = random.Random(seed)
    syllables = ["ta", "lor", "en", "mi", "sha", "qu", "br", "ost", "é", "ul"]
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n))


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def rows():
    base = [prose(120, i) for i in range(12)]
    texts = [*base, None, "", " \n\t ", base[0], base[1] + " end", "\n".join(base[2:5]), prose(3000, 99), "word", "a<|endoftext|>b 😀  two\r\nthree ", "x" * 5000, base[3].upper(), "same three words " * 30]
    return [(i, t, ["en", "de", None, "xx"][i % 4]) for i, t in enumerate(texts)] + [(0, base[0], "en"), (None, base[5], "en")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "id", 2, "k", "l", 3, 4, [1]) for i, t, lang in rows], KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def ids_of(text):
    from tokenizers import Tokenizer

    global LIB
    LIB = globals().get("LIB") or Tokenizer.from_file(VOCAB)
    return LIB.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def test_token_counts(docs, rows, none):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, VOCAB).collect())
    want = Counter((i, len((t or "").encode()), n := len(ids_of(t)), n > 1024) for i, t, _ in rows)
    assert got == want and not token_counts(none, VOCAB).count()


def test_token_output_round_trip(spark, docs, rows, none, tmp_path):
    write_tokens(docs, str(tmp_path / "t"), VOCAB)
    at, want = 0, []
    for i, t, _ in ordered(rows):
        ids = [*ids_of(t), 0]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    got = [tuple(r) for r in token_digests(spark, str(tmp_path / "t")).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert Counter(got) == Counter(want)
    assert "ids" not in read_tokens(spark, str(tmp_path / "t"), ids=False).columns
    some = read_tokens(spark, str(tmp_path / "t"), first=3, last=8)
    assert sorted((r.id, list(r.ids)) for r in some.collect()) == sorted((i, [*ids_of(t), 0]) for i, t, _ in rows if i is not None and 3 <= i <= 8)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,3)" in plan and "LessThanOrEqual(id,8)" in plan
    write_tokens(none, str(tmp_path / "e"), VOCAB)
    assert not token_digests(spark, str(tmp_path / "e")).count()


def test_packing(docs, rows, none):
    got = pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), VOCAB, block_tokens=3000).collect()
    ids = {i: [*ids_of(t), 0] for i, t, _ in rows if i is not None}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))] and sum(p.length for p in pieces) == len(ids[i])
    padded = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        n = sum(p.length for p in pieces)
        assert n <= 1024
        padded += 0 if n & (n - 1) == 0 else 1024 - n
    assert padded < 0.25 * sum(map(len, ids.values())) and not pack(none, VOCAB).count()


def repeat_words(w):
    three = Counter(zip(w, w[1:], w[2:]))
    hit = {k for i in range(len(w) - 2) if three[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    return len(hit)


def test_quality_counts(docs, rows, none):
    got = {(r.doc_id, r.n_words): r for r in quality(docs).collect()}
    for i, t, _ in rows:
        w = (t or "").encode().split()
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        want = (sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeat_words(w))
        r = got[i, len(w)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * want[3] > 50 * len(w))
        assert r.kept == (not r.base_failed and r.lower <= r.logp <= r.upper)
    assert len(quality(docs).collect()) == len(rows) and not quality(none).count()


def test_kneser_ney_sums_to_at_most_one(docs):
    model = kneser_ney(gram_counts(docs.select(F.lit("en").alias("lang"), "text")))
    top = model.withColumn("ctx", F.shiftright("gram", WIDTH)).groupBy("ctx").agg(F.sum(F.pow(F.lit(10.0), "logp")).alias("p"), F.min("logp").alias("least")).agg(F.max("p"), F.min("p")).first()
    assert 0 < top[1] <= top[0] <= 1 + 1e-9


def fingerprint(text, n):
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(items, linked):
    root = {k: k for k in items}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = list(items)
    for a in range(len(keys)):
        for b in range(a):
            if linked(items[keys[a]], items[keys[b]]):
                x, y = sorted((find(keys[a]), find(keys[b])))
                root[y] = x
    return {k: find(k) for k in keys}


def test_simhash(spark, docs, rows, none):
    r = random.Random(7)
    more = []
    for k in range(40):  # near copies of one text, and chains of them
        w = prose(150, 5).split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "zz"
        more.append((1000 + k, " ".join(w), None))
    all_rows = [x for x in rows if x[0] is not None] + more
    fp = {i: fingerprint(t, 4) for i, t, _ in all_rows}
    want = groups(fp, lambda a, b: (a ^ b).bit_count() <= 4)
    df = spark.createDataFrame([(i, t) for i, t, _ in all_rows], "doc_id long, text string")
    got = simhash_groups(df).collect()
    assert Counter((x.doc_id, x.fingerprint, x.component_id) for x in got) == Counter((i, f"{fp[i]:016x}", want[i]) for i, _, _ in all_rows)
    assert len(set(want.values())) < len(want) and not simhash_groups(none).count() and simhash_groups(docs).count() == len(rows)


def shingles(t, n=5):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def test_near_copies_of_the_stage(spark, rows, none):
    r = random.Random(11)
    texts = []
    for k in range(25):  # copies with changed words: similarities on either side of 0.8
        w = prose(r.randint(60, 400), 700 + k).split()
        texts += [" ".join(w)] + [" ".join("zz" if r.random() < p else x for x in w) for p in (0.005, 0.01, 0.02, 0.03, 0.06)]
    all_rows = [x[:2] for x in rows if x[0] is not None][:-1] + [(2000 + k, t) for k, t in enumerate(texts)]
    of = {i: shingles(t) for i, t in all_rows}
    alike = lambda a, b: a == b or len(a & b) / len(a | b) >= 0.8
    root = groups(of, alike)
    df = spark.createDataFrame(all_rows, "doc_id long, text string")
    assert {x.doc_id for x in one_of_each_group(df).collect()} == {i for i in of if root[i] == i}
    bits = {i: fingerprint(t, 5) for i, t in all_rows}
    assert any(alike(of[a], of[b]) and (bits[a] ^ bits[b]).bit_count() > 4 for a in of for b in of)
    assert not one_of_each_group(none).count()


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def brute_classes(rows, edits=2, least=20):
    lines = {}
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n") if t is not None else []):
            if x := x.strip(" \t\r\v\f"):
                lines[i, n] = x
    at = {}
    for k in sorted(lines):
        at.setdefault(lines[k], k)
    letters = {x: Counter(x) for x in at}
    near = lambda a, b: min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and sum(((letters[a] - letters[b]) + (letters[b] - letters[a])).values()) <= 2 * edits and distance(a, b) <= edits
    root = groups({k: x for x, k in at.items()}, near)
    return {k: root[at[x]] for k, x in lines.items()}


def edited(x, n, r):
    x = list(x)
    for _ in range(n):
        k, how = r.randrange(len(x)), r.randrange(3)
        x[k : k + (how < 2)] = [r.choice("abcéz")] if how else []
    return "".join(x)


def test_line_dedup(spark, none):
    r = random.Random(3)
    base = [prose(r.randint(4, 30), 500 + k) for k in range(25)]
    texts = ["\n".join(edited(r.choice(base), r.randint(0, 3), r) for _ in range(6)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "short\n\nlines", "y" * 3000 + "\n" + "y" * 3001, "😀" * 30 + "\n" + "😀" * 29])]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    want = brute_classes(rows)
    got = {(x.id, x.line_no): (x.class_id, x.class_line_no) for x in line_classes(df).collect()}
    assert got == want and any(k != v for k, v in want.items())
    report = {x.doc_id: x for x in line_report(df).collect()}
    left = {x.doc_id: x.text for x in dedup_lines(df).collect()}
    for i, t in rows:
        gone = [n for n in range(len((t or "").split("\n"))) if want.get((i, n), (i, n)) != (i, n)]
        assert list(report[i].removed_lines) == gone and report[i].n_removed == len(gone)
        keep = [x for n, x in enumerate((t or "").split("\n")) if n not in gone]
        if gone and not any(x.strip() for x in keep):
            assert i not in left
        else:
            assert left[i] == (t if not gone else "\n".join(keep))
    assert not line_report(none).count() and dedup_lines(df).columns == df.columns


def ppm(train, text):
    """Log10 probability of ``text``, byte by byte, from dictionaries."""
    seq = lambda w: b"\n" * ORDER + b" ".join(w) + b"\n"
    at = {}
    for w in train:
        s = seq(w)
        for i in range(ORDER, len(s)):
            for k in range(ORDER + 1):
                at.setdefault(s[i - k : i], Counter())[s[i]] += 1
    s, out = seq(text), 0.0
    for i in range(ORDER, len(s)):
        gone, known = set(), False
        for k in range(ORDER, -1, -1):
            c = at.get(s[i - k : i])
            if c is None:
                continue
            c = {b: n for b, n in c.items() if b not in gone}
            t, d = sum(c.values()), len(c)
            if s[i] in c:
                out += math.log10(c[s[i]] / (t + d))
                known = True
                break
            if d:
                out += math.log10(d / (t + d))
            gone |= set(c)
        if not known:
            out -= math.log10(256 - len(gone))
    return out


def test_lm_scoring(docs, rows, none):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [words(t) for i, t, _ in rows if not held(i)]
    c = Counter(w for x in train for w in x)
    n, v, ends = sum(c.values()) + len(train), len(c) + 1, len(train)
    got = {(r.doc_id, r.n_tokens): r for r in score(docs).collect()}
    assert any(held(i) for i, _, _ in rows)
    for i, t, _ in rows:
        w = words(t)
        r = got[i, len(w) + 1]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (r.held_out, r.n_known, r.train_tokens) == (held(i), sum(c[x] > 0 for x in w) + 1, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if len(w) < 400:
            assert r.score == pytest.approx(ppm(train, w), rel=1e-6)
    assert score(docs).count() == len(rows) and not score(none).count()


def test_decontamination(spark, none):
    items = [(k, prose(60, 900 + k)) for k in range(5)] + [(9, None), (10, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    half = items[2][1].split()
    for k in range(0, 40, 7):
        half[k] = "other"
    rows = [(k, prose(300, 50 + k)) for k in range(60)] + [(100, prose(200, 1) + " " + items[0][1] + " " + prose(200, 2)), (101, items[1][1].upper()), (102, prose(90, 4) + " " + " ".join(half)), (103, None), (104, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item string")
    got = {(r.doc_id, r.item_id) for r in matches(df, bench).collect()}
    assert got == {(100, 0), (101, 1), (102, 2)}
    assert {r.doc_id for r in clean(df, bench).collect()} == {i for i, _ in rows} - {100, 101, 102}
    assert matches(df, bench.where("item_id < 0")).count() == 0 and matches(none, bench).count() == 0


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark, none):
    text = "pay 4111-1111 1111 1111 or 4111111111111112, mail jo.doe@ex.org, born 1980-02-29 or 31.02.2000, ip 10.0.0.255 not 300.1.1.1, ssn 123-45-6789, call +44 20 7946 0958, DE89 3704 0044 0532 0130 00"
    df = spark.createDataFrame([(1, text, "a"), (2, "again " + text, "b"), (3, None, "c"), (4, "", "d"), (5, "no values 12", "e")], "doc_id long, text string, pii_values string")
    out = {r.doc_id: r for r in pii_report(df, "key").collect()}
    assert set(out) == {1, 2} and out[1].pseudonyms == out[2].pseudonyms and out[1].n_values == 7
    assert out[1].kinds == ["card", "date", "email", "iban", "ip", "phone", "ssn"]
    by = {r["kind"]: r["new"] for r in pseudonymise(df, "key").where("doc_id = 1").first().pii_values}
    assert luhn("".join(c for c in by["card"] if c.isdigit())) and by["card"][4] == "-" and by["email"].endswith("@ex.org") and by["phone"].startswith("+44 ")
    assert "4111111111111112" in out[1].text and "31.02.2000" in out[1].text and "300.1.1.1" in out[1].text and "jo.doe@ex.org" not in out[1].text
    other = pii_report(df, "another").where("doc_id = 1").first()
    assert other.pseudonyms != out[1].pseudonyms
    kept = {r.doc_id: r.text for r in pseudonymise(df, "key").collect()}
    assert kept[3] is None and kept[4] == "" and kept[5] == "no values 12" and not pii_report(none, "key").count()


def test_pii_is_a_permutation(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("at 10.0."), F.floor(F.col("id") / 256), F.lit("."), F.col("id") % 256, F.lit(" on "), F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).cast("string")).alias("text"))
    got = pii_report(df, "key").select(F.explode("pseudonyms").alias("v"))
    assert got.count() == got.distinct().count() == 6000


def test_licenses(spark, none):
    rows = [(1, "a/LICENSE", "Licensed under the Apache License, Version 2.0"), (2, "a/b/c/x.py", "code"), (3, "a/y.py", "# Released under the MIT License\ncode"), (4, "z/q.py", "nothing licensed here at all"), (5, None, None), (6, "a/b/COPYING", "GNU General Public License\nVersion 3, 29 June 2007"), (7, "a/k.py", None)]
    got = {r.doc_id: (r.licence, r.how, r.licence_dir) for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("Apache-2.0", "file", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("MIT", "header", None), 6: ("GPL-3.0", "file", None), 7: ("Apache-2.0", "inherited", "a")}
    assert not license_scan(none.withColumn("path", F.col("id"))).count()


def test_license_query_inherits(spark, tmp_path):
    from foliate.llm.queries import op10_licenses

    mit, gpl = "Released under the MIT License\nx", "GNU General Public License Version 3"
    rows = [(1, mit, "en", "s"), (2, gpl, "en", "s"), (3, "plain", "en", "s"), (4, "plain", "de", "s"), (5, mit, "en", "s"), (6, "plain", "en", "t"), (7, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.licence, r.how, r.licence_dir) for r in op10_licenses(spark, str(tmp_path)).collect()}
    assert got == {1: ("MIT", "file", None), 2: ("GPL-3.0", "file", None), 3: ("GPL-3.0", "inherited", "s/en"), 4: ("MIT", "inherited", "s"), 5: ("MIT", "header", None), 7: ("GPL-3.0", "inherited", "s/en")}


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    kept = {r.doc_id for r in quality(docs).where("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    classes, lines = brute_classes(rows), []
    for i, t in rows:
        keep = [x for n, x in enumerate(t.split("\n")) if classes.get((i, n), (i, n)) == (i, n)]
        if len(keep) == len(t.split("\n")) or any(x.strip(" ") for x in keep):
            lines.append((i, "\n".join(keep)))
    of = {i: shingles(t) for i, t in lines}
    root = groups(of, lambda a, b: a == b or len(a & b) / len(a | b) >= 0.8)
    one = [(i, t) for i, t in lines if root[i] == i]
    leaked = {r.doc_id for r in matches(spark.createDataFrame(one, "doc_id long, text string"), bench).collect()}
    want = {i: len(ids_of(t)) + 1 for i, t in one if i not in leaked}
    got = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == want and len(want) < docs.count()
