"""The methods of the training-data operators against plain versions of them, and their edge cases."""

import datetime
import hashlib
import hmac
import math
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliate.llm import packing
from foliate.llm.decontaminate import matches
from foliate.llm.licenses import BSD, BSD_NAMES, BSD_WARRANTY, TEMPLATES, license_scan, scan, terms, with_identifiers
from foliate.llm.line_dedup import dedup_lines, line_classes, line_report
from foliate.llm.packing import best_cuts, cut_points
from foliate.llm.pii import pii_report, pseudonymise
from foliate.llm.quality import quality
from foliate.llm.shared import cut, drop, fresh, map_arrow, shared_dir
from foliate.llm.stages import good_documents, one_of_each_group


def prose(n, seed):
    r = random.Random(seed)
    syllables = ["ta", "lor", "en", "mi", "sha", "qu", "br", "ost", "é", "ul"]
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n))


# --- quality rules: modified Kneser-Ney in dictionaries


def symbol(c):
    signs = [x for x in range(33, 127) if not chr(x).isalnum()]
    if c in " \t\n\v\f\r":
        return 0
    if c.isascii() and c.isalpha():
        return 1 + ord(c.lower()) - 97
    if c.isascii() and c.isdigit():
        return 27 + int(c)
    return 37 + signs.index(ord(c)) if ord(c) in signs else 69 if ord(c) < 128 else 70 + ord(c) % 58


def three(text):
    s = [0, 0, *map(symbol, text), 0]
    return [tuple(s[i : i + 3]) for i in range(len(s) - 2)]


def plain_model(texts):
    level = Counter(g for t in texts for g in three(t))
    levels = [level]
    for k in (2, 1):
        levels.append(Counter(g[-k:] for g in levels[-1]))
    p = None
    for level in reversed(levels):
        n = [0, *[sum(c == r for c in level.values()) for r in (1, 2, 3, 4)]]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [0, *[min(r, max(0, r - (r + 1) * y * n[r + 1] / n[r] if n[r] else 0.5)) for r in (1, 2, 3)]]
        total, left = Counter(), Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        p = {g: (c - d[min(c, 3)]) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * (p[g[1:]] if p else 1 / 128) for g, c in level.items()}
    return p


def test_quality_is_kneser_ney_with_bands(spark, tmp_path):
    langs = ["en", "ru", "xx", None]
    rows = [(i, prose(80 + i, i) if i % 4 != 1 else " ".join(["привет мир и ещё слова"] * 4 + [prose(60, i)]), langs[i % 4]) for i in range(40)]
    rows += [(90, "zq" * 200 + " " + "#$ " * 70, "en"), (91, None, "en"), (92, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality(df).collect()}
    of = lambda lang: lang if lang in ("de", "en", "es", "fr") else ""
    model = {m: plain_model([t for _, t, lang in rows if t and of(lang) == m]) for m in {of(lang) for *_, lang in rows}}
    logp = {i: sum(math.log10(model[of(lang)][g]) for g in three(t)) / len(three(t)) for i, t, lang in rows if t}
    for lang in langs:
        own = sorted(logp[i] for i, t, x in rows if x == lang and t and not got[i].base_failed)
        q = [own[math.ceil(p * len(own)) - 1] for p in (0.25, 0.5, 0.75)]
        lower, upper = q[1] - 10 * max(q[1] - q[0], 0.002), q[1] + 10 * max(q[2] - q[1], 0.002)
        for i, t, x in rows:
            if x == lang and t:
                assert got[i].logp == pytest.approx(logp[i], abs=1e-5) and got[i].lower == pytest.approx(lower, abs=1e-4) and got[i].upper == pytest.approx(upper, abs=1e-4)
    assert got[91].n_words == 0 and got[91].base_failed and not got[92].kept


def test_quality_rejects_noise(spark):
    rows = [(i, prose(100, i), "en") for i in range(60)] + [(100, " ".join("".join(random.Random(j).choices("xqzjkvw0189%$", k=7)) for j in range(100)), "en")]
    kept = {r.doc_id for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("kept").collect()}
    assert kept == set(range(60))


# --- packing: memory in the pipeline; a monotone queue against all pairs


def test_pipeline_packs_in_little_memory(spark, monkeypatch):
    import corpus_pipeline

    tasks = []
    monkeypatch.setattr(packing, "map_arrow", lambda rows, f, schema: tasks.append(f) or map_arrow(rows, f, schema))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [prose(1000, seed) for seed in range(600)]
    corpus_pipeline.packing(spark, spark.createDataFrame([(0, "")], "doc_id long, text string"), "")
    batch = pa.record_batch({"id": pa.array(range(len(texts))), "text": pa.array(texts)})
    list(tasks[0](iter([batch.slice(0, 1)])))  # the vocabulary is read
    before, most = pa.total_allocated_bytes(), 0
    tracemalloc.start()
    for part in tasks[0](iter([batch])):
        most = max(most, pa.total_allocated_bytes() - before)
    most += tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 << 20, (batch.nbytes, most)



def test_best_cuts_is_a_least_cost_packing():
    r = np.random.default_rng(5)
    for seed in range(60):
        n = int(r.integers(1, 400))
        doc_ends = np.unique(np.append(r.integers(1, n + 1, 6), n))
        sentences = np.unique(r.integers(1, n + 1, 20))
        limit = int(r.choice([16, 40, 100, 300]))
        points, cost = cut_points(doc_ends, sentences, 8, 0.5, 4.0)
        pos, f = [0, *points.tolist()], [0.0]
        for j in range(1, len(pos)):
            pad = lambda w: 0 if w >= 128 and w & (w - 1) == 0 else limit - w
            f.append(min(f[i] + pad(pos[j] - pos[i]) for i in range(j) if pos[j] - pos[i] <= limit) + 1.0 + cost[j - 1])
        stops = best_cuts(points, cost, limit)
        at = dict(zip(points.tolist(), cost.tolist()))
        spent = sum(pad(b - a) + 1.0 + at[b] for a, b in zip([0, *stops[:-1]], stops))
        assert stops[-1] == n and all(b - a <= limit for a, b in zip([0, *stops[:-1]], stops)) and spent == pytest.approx(f[-1])


# --- decontamination: recall against an exact search


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def exact_share(item, window, content):
    """The share of an item's words found in a window: of its content words or of all, whichever is less."""
    own = [x for x in item if x in content] or item
    inner = lcs(own, [x for x in window if x in own]) / len(own)
    return min(inner, lcs(item, window) / len(item)) if inner >= 0.5 else 0


@pytest.mark.parametrize("given", [{}, {"content_idf": 0.0}], ids=["defaults", "all words count"])
def test_decontamination_recall_against_exact_search(spark, given):
    r = random.Random(1)
    common = prose(400, 77).split()
    text = lambda n, k: " ".join(r.choice(common) if r.random() < 0.5 else prose(1, r.randrange(10**9)) for _ in range(n))
    items = [(k, text(28, k)) for k in range(60)] + [(60, text(90, 60))]
    docs, want = [(k, text(150, k)) for k in range(150)], set()
    for k, (_, t) in enumerate(items[:60]):  # each item with a share of its words changed
        w = [x if r.random() > r.choice([0, 0.1, 0.2, 0.4]) else prose(1, r.randrange(10**9)) for x in t.split()]
        docs.append((1000 + k, f"{text(r.randint(0, 120), 1)} {' '.join(w)} {text(80, 2)}"))
    for k, (_, t) in enumerate(items[:60]):  # and with two words of five changed
        w = [prose(1, r.randrange(10**9)) if i % 5 in (1, 3) else x for i, x in enumerate(t.split())]
        docs.append((3000 + k, f"{text(40, 5)} {' '.join(w)}"))
    long_item = items[60][1].split()
    docs += [(2000, text(50, 3) + " " + " ".join(long_item[:30]) + " " + text(50, 4)), (2001, None), (2002, ""), (1000, docs[150][1])]
    least = given.get("content_idf", 3.0)
    df = Counter(x for _, d in docs for x in set((d or "").split()))
    idf = {x: math.log((len(docs) + 1) / (df[x] + 1)) + 0.1 for _, t in items for x in t.split()}
    content, place = {x for x, v in idf.items() if v >= least}, {x: k for k, x in enumerate(idf)}
    kinds = Counter()
    for i, d in docs:
        for item, t in items[:60]:
            w, own = (d or "").split(), t.split()
            windows = [w[a : a + 60] for a in range(0, max(len(w) - 30, 1), 30)]
            shares = [exact_share(own, x, content) if len(set(own) & set(x)) > 7 else 0 for x in windows]
            answer = set(sorted(set(own), key=lambda x: (-idf[x], place[x]))[:3])
            told = any(s >= 0.5 and answer <= set(x) for s, x in zip(shares, windows, strict=True))
            kind = "verbatim" if max(shares) >= 0.75 else "paraphrase" if max(shares) >= 0.5 and told else None
            if kind:
                want.add((i, item))
                kinds[kind] += 1
    got = matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **given).collect()
    found = {(x.doc_id, x.item_id) for x in got}
    assert kinds["verbatim"] > 30 and kinds["paraphrase"] > 5 and len(want & found) >= 0.9 * len(want)
    assert {(x.kind, x.passage_share) for x in got if x.doc_id == 2000} == {("passage", 1.0)}
    assert all(x.doc_id >= 1000 for x in got) and sum(x.doc_id == 1000 for x in got) in (0, 2)


# --- PII: a second Feistel network


def sub(key, kind):
    return hmac.new(key.encode(), kind.encode(), "sha256").hexdigest()


def number(key, r, half, size):
    return int(hashlib.sha256(f"{key}|{r}|{half}".encode()).hexdigest()[:12], 16) % size


def numbers(x, high, low, key, back=False):
    h, l = divmod(x, low)  # noqa: E741
    for r in range(6, 0, -1) if back else range(1, 7):
        s = -1 if back else 1
        if r % 2 == 0:
            h = (h + s * number(key, r, l, high)) % high
        else:
            l = (l + s * number(key, r, h, low)) % low  # noqa: E741
    return h * low + l


def letters(x, key, back=False):
    m = (len(x) + 1) // 2
    a, b = x[:m], x[m:]

    def move(half, other, r):
        out = ""
        for i, c in enumerate(half):
            first, size = (48, 10) if "0" <= c <= "9" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (None, 0)
            out += c if first is None else chr(first + (ord(c) - first + (-1 if back else 1) * number(key, r, f"{i}|{other}", size)) % size)
        return out

    for r in range(6, 0, -1) if back else range(1, 7):
        a, b = (move(a, b, r), b) if r % 2 == 0 else (a, move(b, a, r))
    return a + b


def test_pii_against_a_second_feistel(spark):
    values = ["jo.doe@ex.org", "10.1.2.3", "3782 822463 10005", "4111 1111 1111 1111", "(555) 234-4567", "1980-02-29", "24.12.1899", "7.3.2001", "31/12/1999", "12/25/2020"]
    rows = [(i, f"x {v} y", 1, 2) for i, v in enumerate(values)] + [(50, None, 1, 2), (51, "", 1, 2), (None, "mail jo.doe@ex.org", 1, 2), (52, "jo.doe@ex.org " * 3000, 1, 2), (0, "x jo.doe@ex.org y", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found int, valid int")
    out = pseudonymise(df, "key").collect()
    assert len(out) == len(rows) and all((r.found, r.valid) == (1, 2) for r in out)
    got = {r.doc_id: r.pii_values[0]["new"] for r in out if r.pii_values and r.doc_id != 52}
    local = letters("jo.doe", sub("key", "email"))
    assert got[0] == f"{local}@ex.org" == got[None] and letters(local, sub("key", "email"), back=True) == "jo.doe"
    ip = numbers(int.from_bytes(bytes([10, 1, 2, 3])), 65536, 65536, sub("key", "ip"))
    assert got[1] == ".".join(map(str, ip.to_bytes(4))) and numbers(ip, 65536, 65536, sub("key", "ip"), back=True) == 0x0A010203
    for i, d in ((2, "378282246310005"), (3, "4111111111111111")):
        new = "".join(c for c in got[i] if c.isdigit())
        assert new[:-1] == letters(d[:-1], sub("key", "card")) and [len(p) for p in got[i].split()] == [len(p) for p in values[i].split()]
    assert got[4] == "(555) {0}-{1}".format(*(lambda s: (s[:3], s[3:]))(str(numbers(344567, 3200, 2500, sub("key", "phone")) + 2_000_000)))
    near = datetime.date(1900, 1, 1)
    turned = lambda y, m, d: near + datetime.timedelta(numbers((datetime.date(y, m, d) - near).days, 271, 270, sub("key", "date")))
    assert got[5] == str(turned(1980, 2, 29)) and got[9] == turned(2020, 12, 25).strftime("%m/%d/%Y")
    d = turned(2001, 3, 7)
    assert got[7] == f"{d.day}.{d.month}.{d.year}"
    d = turned(1999, 12, 31)
    while d.day <= 12:  # only the second reading gave a day
        d = turned(d.year, d.month, d.day)
    assert got[8] == d.strftime("%d/%m/%Y") and got[6] != values[6]
    assert {r.text for r in out if r.doc_id == 52} == {f"{local}@ex.org " * 3000}


def test_pii_days_are_permuted_in_every_form(spark):
    days = spark.range(3000).select(F.date_add(F.lit("1885-01-01").cast("date"), F.col("id").cast("int") * 13).alias("d"))
    for form in ("dd/MM/yyyy", "d.M.yyyy", "MM-dd-yyyy", "yyyy-MM-dd"):
        got = pii_report(days.select(F.lit(1).alias("doc_id"), F.date_format("d", form).alias("text")), "key").select("text").collect()
        assert len(got) == len({r.text for r in got}) == 3000, form


def test_pii_leaves_what_is_not_valid(spark):
    rows = [(i, t) for i, t in enumerate(["155-234-4567", "2020-02-30", "1.2.3", "version 10.12.20", "4111 1111 1111 1112", "300.1.1.1", "BE00 5390 0754 7034"])]
    assert not pii_report(spark.createDataFrame(rows, "doc_id long, text string"), "key").count()
    (r,) = pii_report(spark.createDataFrame([(1, "pay BE68 5390 0754 7034 THEN go")], "doc_id long, text string"), "key").collect()
    assert r.kinds == ["iban"] and r.text.endswith(" THEN go")


# --- licences: cosines by hand


def plain_scores(text):
    rows = [(n, terms(t)) for n, ts in with_identifiers(TEMPLATES).items() for t in ts]
    df = Counter(w for _, c in rows for w in c)
    idf = lambda w: math.log((1 + len(rows)) / (1 + df[w])) + 1
    vec = lambda c: {w: k * idf(w) for w, k in c.items()}
    v = vec(terms(text))
    norm = lambda x: math.sqrt(sum(y * y for y in x.values())) or 1.0
    return min(((sum(x * v.get(w, 0) for w, x in t.items()) / norm(t) / norm(v), n) for n, t in ((n, vec(c)) for n, c in rows)), key=lambda s: (-round(s[0], 9), s[1]))


def test_license_scores_against_plain_cosine(spark):
    lines = ["SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: Apache-2.0", "Released under the MIT License (c) me", BSD, f"{BSD} {BSD_NAMES}", f"{BSD} {BSD_NAMES} {BSD_WARRANTY}", "licence unknown to all", "GNU General Public License version 3"]
    rows = [(i, t, "x") for i, t in enumerate(lines)] + [(None, lines[0], "x"), (0, lines[0], "x"), (20, None, "x"), (21, "", "x"), (22, "word " * 50_000 + "\n" + lines[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licence string").withColumn("path", F.lit(None).cast("string"))
    got = sorted(((r.id is None, r.id or 0, r.licence, round(r.score, 9)) for r in scan(df).collect()))
    want = []
    for i, t, _ in rows:
        found = max((plain_scores(x)[0], plain_scores(x)[1]) for x in [(t or "").split("\n")[-1]])
        if t and found[0] >= 0.6:
            want.append((i is None, i or 0, found[1], round(found[0], 9)))
    assert got == sorted(want)
    by = {k: n for _, k, n, _ in got}
    assert (by[0], by[1], by[3], by[5]) == ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause")


def test_license_file_is_matched_whole_and_null_ids_once(spark):
    text = "Some licence\n\nCopyright (c) 2020 Somebody\n\n" + "\n".join(f"{BSD} {BSD_NAMES} {BSD_WARRANTY}"[i : i + 70] for i in range(0, 2000, 70))
    rows = [(1, "a/LICENSE", text), (None, "a/x.py", "# SPDX-License-Identifier: ISC"), (None, "a/y.py", "code"), (3, "a/b/z.py", "code"), (3, "b/z.py", "code")]
    got = sorted(((r.doc_id or 0, r.path, r.licence, r.how) for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()))
    assert got == [(0, "a/x.py", "ISC", "header"), (1, "a/LICENSE", "BSD-3-Clause", "file"), (3, "a/b/z.py", "BSD-3-Clause", "inherited")]


# --- lines: short ones, repeats, links


def test_short_lines_repeats_and_links(spark):
    long = "a line of more than twenty characters"
    rows = [(1, f"ab\n{long}\n\n  ab "), (2, "ab\nac"), (3, f"{long}s\n{long}"), (3, f"{long}s\n{long}"), (None, "ab"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(7)).withColumn("left_lines", F.lit("x"))
    got = Counter((x.doc_id, x.n_lines, x.n_removed, x.n_links, tuple(x.removed_lines), tuple(x.class_docs)) for x in line_report(df).collect())
    three = (3, 2, 2, 2, (0, 1), (1, 1))
    assert got == Counter([(1, 4, 2, 1, (0, 3), (None, 1, None)), (2, 2, 1, 0, (0,), (None, 2)), three, three, (None, 1, 0, 0, (), (None,)), (4, 0, 0, 0, (), ()), (5, 1, 0, 0, (), ())])
    left = Counter((x.doc_id, x.text, x.gone, x.left_lines) for x in dedup_lines(df).collect())
    assert left == Counter([(1, f"{long}\n", 7, "x"), (2, "ac", 7, "x"), (None, "ab", 7, "x"), (4, None, 7, "x"), (5, "", 7, "x")])


def test_hash_clashes_are_told_apart(spark, monkeypatch):
    import foliate.llm.line_dedup as lines

    hashed = F.xxhash64
    monkeypatch.setattr(lines.F, "xxhash64", lambda *c: hashed(*c) if len(c) != 1 or c[0] != "line" else hashed(F.length("line")))
    df = spark.createDataFrame([(1, "ab\ncd"), (2, "ab\nef")], "doc_id long, text string")
    assert {(r.id, r.line_no, r.class_id) for r in line_classes(df).collect()} == {(1, 0, 1), (1, 1, 1), (2, 0, 1), (2, 1, 2)} and len({(r.class_id, r.class_line_no) for r in line_classes(df).collect()}) == 3


# --- shared


def test_cuts_can_be_dropped(spark):
    import os

    a = cut(spark.range(5).toDF("x"))
    (folder,) = {os.path.dirname(f).removeprefix("file://") for f in a.inputFiles()}
    assert a.count() == 5 and os.path.isdir(folder)
    drop(a)
    assert not os.path.exists(folder) and shared_dir(spark) and fresh(["a", "A_"], "a") == "a__"


def test_stages_keep_clashing_columns(spark):
    rows = [(i, prose(100, i % 5), "en", "keep", 1, 2) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, gone_id string, __id int, first int")
    assert good_documents(df).columns == df.columns and {r.doc_id for r in one_of_each_group(df).collect()} == set(range(5))
    none = df.where("false")
    assert not good_documents(none).count() and not one_of_each_group(none).count()
