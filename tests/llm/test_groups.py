"""Spelling variants, the conversations' trie and substring dedup against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from foliate.llm import substrings, variants
from foliate.llm.conversations import conversation_trie, trie_nodes
from foliate.llm.queries import ORACLE, QUERIES
from foliate.llm.substrings import drop_repeats, repeated_spans
from foliate.llm.variants import near, spelling_variants, trie

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(names).collect()))) == sorted(map(repr, want.fetchall()))


# --- substring dedup


def plain_removal(rows, window):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(x[p : p + window]) for _, x in texts for p in range(len(x) - window + 1))
    out = []
    for i, x in texts:
        gone = {p + k for p in range(len(x) - window + 1) if seen[tuple(x[p : p + window])] > 1 for k in range(window)}
        out.append((i, " ".join(w for k, w in enumerate(x) if k not in gone), len(x), len(gone)))
    return sorted(map(repr, out))


def some_texts(seed):
    r = random.Random(seed)
    rows = [(None if r.random() < 0.1 else i // 2, None if r.random() < 0.1 else r.choice([" ", "\n", " \t "]).join(r.choice(["a", "b", "é", "\xa0"]) for _ in range(r.randint(0, 90)))) for i in range(40)]
    shared = " ".join(r.choice("abcdefghij") + str(r.randint(0, 9)) for _ in range(60))
    rows += [(100 + i, "x" * i + f" {i} " + shared[i:] + f" tail {i}") for i in range(8)]
    return [*rows, *rows[:5], (200, ""), (201, "  \n "), (202, "a " * 300), (203, shared + " " + shared)]


@pytest.mark.parametrize("window", [2, 3, 7, 35])
def test_substrings_against_brute_force(spark, window):
    rows = some_texts(window)
    got = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window)
    assert sorted(repr((r.doc_id, r.text, r.n_words, r.n_removed)) for r in got.collect()) == plain_removal(rows, window)


def test_substrings_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 7)
    text = b"one two  three\nabcdefghijklmnopqrstuvwxyz four " * 3
    assert b"".join(substrings.pieces(text)) == text
    starts, hashes = substrings.word_hashes(text)
    assert [bytes(text[s:]).split()[0] for s in starts] == text.split()
    assert len(set(hashes.tolist())) == len(set(text.split()))


def test_substrings_keep_other_columns_and_empty_tables(spark):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(1, text, 5, "u"), (2, text + " end", 6, None)], "doc_id long, text string, n_words int, row string")
    got = drop_repeats(df)
    assert got.columns == ["doc_id", "text", "n_words", "row", "n_words_", "n_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, "", 5, "u", 40, 40), (2, "end", 6, None, 41, 40)]
    assert drop_repeats(df.limit(0)).count() == 0
    assert repeated_spans(df).count() == 2
    with pytest.raises(ValueError, match="two words"):
        drop_repeats(df, 1)


# --- spelling variants


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_automaton_finds_each_neighbour_once():
    r = random.Random(3)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 7))) for _ in range(400)} | {"xxx", "xxxxx", "xxxxxx"})
    shared, rests = [], []
    for before, word in zip(["", *words], words, strict=False):
        k = next((i for i, (x, y) in enumerate(zip(before, word, strict=False)) if x != y), min(len(before), len(word)))
        shared.append(k)
        rests.append(word[k:])
    root, got = trie(shared, rests)
    assert got == words
    for w in [*words, "", "aaaaaaaa", "zzz", "xx", "xxxx", "xxxxxxx"]:
        assert sorted(near(root, w)) == [i for i, x in enumerate(words) if distance_one(w, x)], w


def plain_variants(rows, min_length, min_count, k):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % k else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near_ones = {w: [x for x in words if distance_one(w, x)] for w in words}
    best = {w: min(x, key=lambda v: (-words[v], v)) for w, x in near_ones.items() if x}
    form = {w: b for w, b in best.items() if words[b] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(repr((w, form.get(w), root(w), n, len(near_ones[w]), words[form[w]] if w in form else None)) for w, n in words.items())


@pytest.mark.parametrize("shard", [1 << 20, 60])
def test_variants_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(variants, "SHARD_BYTES", shard)  # small shards are broadcast in several rounds
    r = random.Random(shard)
    rows = [(None if r.random() < 0.1 else i, None if r.random() < 0.05 else r.choice([" ", "-", "\n"]).join("".join(r.choice(["Ab", "b", "ß", "×", "Éa"]) for _ in range(r.randint(1, 4))) for _ in range(60))) for i in range(40)]
    rows += [(50, ""), (51, "aaaa aaaaa aaaaaa " * 9 + "aaaaa " * 40 + "x" * 5000 + " " + "x" * 5001), (52, "İstanbul K elvin")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1))
    got = spelling_variants(df, min_length=3, min_count=2, drop_one_in=5)
    assert sorted(repr(tuple(x)) for x in got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == plain_variants(rows, 3, 2, 5)


def test_variants_of_nothing(spark):
    df = spark.createDataFrame([(1, "a bc"), (2, None)], "doc_id long, text string")
    assert spelling_variants(df).count() == 0
    assert spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="twice"):
        spelling_variants(df, ratio=1)


# --- conversations


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, path in full.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaf = lambda n: not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        ends = ",".join(map(str, sorted(c for c in who if len(full[c]) == len(node))))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(len(n) == len(node) + 1 for n in below), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, monkeypatch, seed):
    from foliate.llm import conversations

    monkeypatch.setattr(conversations, "BLOCK", 4)  # so that sums and ids cross blocks
    r = random.Random(seed)
    rows = []
    for c in random.Random(seed).sample(range(60), 40):
        for t in range(r.choice([0, 1, 2, 5, 12])):
            rows.append((c, None if t == 0 and r.random() < 0.3 else t, r.choice(["user", None, "assistant"]), r.choice(["hi", "", None, "ça va"])))
    rows += [(c, t, "user", "same") for c in (61, 62, 63, 64, 66) for t in range(12)]
    rows += [(65, t, "user", str(t % 2)) for t in range(400)] + [(7, 99, "user", "twice")] * 3 + [(None, 1, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("other"))
    got = conversation_trie(df.repartition(3))
    assert sorted(repr(tuple(x)) for x in got.select(NODE).collect()) == plain_trie(rows)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert conversation_trie(df).count() == 0
    only = spark.createDataFrame([(3, 0, 0, 0, 0), (4, 0, 0, 0, 0)], "conv_id long, depth long, x long, y long, size long")
    assert [tuple(x) for x in trie_nodes(only).select(NODE).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,4").hexdigest())]


# --- the pipeline's stages


def test_stages_take_columns_of_any_name_nulls_and_nothing(spark):
    from foliate.llm.stages import first_lines, good_documents, one_of_each_group

    text = " ".join(f"wort{i} haus{i % 7}" for i in range(60))
    near = text.replace("wort30", "other")
    rows = [(1, text, "de", 9, "f"), (2, near, "de", 8, None), (3, text, "de", 7, "g"), (None, "kurz", None, 6, "h"), (4, None, "de", 5, "i"), (5, "", "de", 4, "j"), (5, "", "de", 4, "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, __first int, first_id string")
    got = one_of_each_group(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 4]  # texts without words are copies of each other
    for stage in (good_documents, first_lines, one_of_each_group):
        assert stage(df).columns == df.columns
        assert stage(df.limit(0)).count() == 0


def test_near_dedup_follows_fingerprints_and_shingles(spark):
    import corpus_pipeline
    from foliate.llm.near_copies import jaccard_groups

    turn = "uno dos tres quattro cinque " * 150
    words = [f"w{i}" for i in range(300)]
    near = [x if i != 150 else "other" for i, x in enumerate(words)]  # shingles alike, 4 bits or fewer not asked for
    rows = [(7, turn + "alpha beta gamma delta"), (3, turn + "eins zwei drei vier"), (8, " ".join(words)), (9, " ".join(near)), (None, turn + "x y z"), (11, "quite another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    alone = {r.doc_id: r.component_id for r in jaccard_groups(df).collect()}
    assert alone[7] == 7 and alone[3] == 3 and alone[9] == 8
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [3, 8, 11]
