"""The quality rules' model of bytes against one in dictionaries, and what the model of classes can't tell."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliate.llm.queries import op3_quality
from foliate.llm.quality import CONTEXT, quality

ORDER = CONTEXT + 1


def grams(text):
    b = bytes(32 if 9 <= x <= 13 else x + 32 if 65 <= x <= 90 else x for x in text.encode())
    s = b" " * CONTEXT + b + b" "
    return [s[i : i + ORDER] for i in range(len(b) + 1)]


def plain_model(texts, scored):
    """Log-probabilities of the grams of ``scored`` by the model of ``texts``."""
    levels = [Counter(g for t in texts for g in grams(t))]
    for k in range(CONTEXT, 0, -1):
        levels.append(Counter(g[-k:] for g in levels[-1]))
    asked = {g for t in scored for g in grams(t)}
    p = None
    for k, level in enumerate(reversed(levels), 1):
        n = [0, *[sum(c == r for c in level.values()) for r in (1, 2, 3, 4)]]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [0, *[min(r, max(0.1, r - (r + 1) * y * n[r + 1] / n[r] if n[r] else 0.5)) for r in (1, 2, 3)]]
        total, left = Counter(), Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        last, p = p, {}
        for g in {g[-k:] for g in asked}:
            below, t = last[g[1:]] if last else 1 / 256, total[g[:-1]]
            p[g] = (level[g] - (d[min(level[g], 3)] if level[g] else 0)) / t + left[g[:-1]] / t * below if t else below
    return p


def lexicon(seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghiklmnoprstuvéюя", k=9)) for _ in range(60)]


def prose(words, n, seed):
    return " ".join(random.Random(seed).choices(words, k=n))


def by_threes(text, n, seed):
    """A text whose every three characters are some of ``text``, after the two before them as often as there."""
    r, after = random.Random(seed), {}
    for a, b, c in zip(text, text[1:], text[2:]):
        after.setdefault(a + b, []).append(c)
    out = text[:2]
    while len(out) < n:
        out += r.choice(after.get(out[-2:], [" "]))
    return out


@pytest.mark.parametrize("block_bytes", [2000, 1 << 24])
def test_bytes_are_kneser_ney_in_blocks(spark, block_bytes):
    langs, words = ["en", "ru", "xx", None], lexicon(1)
    rows = [(i // 2, prose(words, 60 + i, i) + "\n\tÀB 漢字", langs[i % 4]) for i in range(40)] + [(90, None, "en"), (91, "", None), (None, prose(words, 70, 90), "de"), (None, "漢", "en"), (92, " \n", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality(df, context=CONTEXT, block_bytes=block_bytes).collect()
    half = dict(df.select("text", F.pmod(F.xxhash64("text"), F.lit(2))).collect())
    of = lambda lang: lang if lang in ("de", "en", "es", "fr") else ""
    texts = lambda m, h: [t for _, t, lang in rows if t and of(lang) == m and half[t] == h]
    model = {(m, h): plain_model(texts(m, 1 - h), texts(m, h)) for m in {of(lang) for *_, lang in rows} for h in (0, 1)}
    want = [(i, len((t or "").encode().split()), sum(math.log10(model[of(lang), half[t]][g]) for g in grams(t)) / len(grams(t)) if t else None) for i, t, lang in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    got = sorted(((r.doc_id, r.n_words, r.logp) for r in got), key=key)
    assert len(got) == len(rows)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and (a[2] is b[2] if b[2] is None else a[2] == pytest.approx(b[2], abs=1e-5))


def test_op3_text_does_not_vouch_for_itself(spark, tmp_path):
    """Random letters are less likely than prose, as often as they are repeated as a whole."""
    words, r = lexicon(3), random.Random(4)
    noise = " ".join("".join(r.choices("qwxzjkvbf", k=8)) for _ in range(200))
    rows = [(i, prose(words, 100 + i, i), "en") for i in range(60)] + [(100, noise, "en"), (101, noise, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op3_quality(spark, str(tmp_path)).collect()}
    assert all(got[i].logp < min(got[k].logp for k in range(60)) - 0.5 and not got[i].kept for i in (100, 101))


def test_bytes_of_nothing(spark):
    assert not quality(spark.createDataFrame([], "doc_id long, text string, lang string"), context=CONTEXT).count()


def test_op3_rejects_text_that_is_right_only_by_threes(spark, tmp_path):
    """Such a text passed with contexts of two characters."""
    words = lexicon(2)
    rows = [(i, prose(words, 150 + i, i), "en") for i in range(80)]
    rows.append((100, by_threes(" ".join(t for _, t, _ in rows), 1500, 7), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id: (r.kept, r.base_failed) for r in op3_quality(spark, str(tmp_path)).collect()}
    assert kept[100] == (False, False) and all(kept[i][0] for i in range(80))


def test_op3_tells_letters_that_shared_a_class(spark, tmp_path):
    """ш and һ are 99 - 41 = 58 code points apart."""
    a, b = "ш", chr(ord("ш") + 58)
    rows = [(i, prose(["пашма", "ноша", "шар", "мост", "рука"], 80 + i, i), "ru") for i in range(60)]
    rows.append((100, rows[0][1].replace(a, b), "ru"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.logp for r in op3_quality(spark, str(tmp_path)).collect()}
    assert got[100] < got[0] - 1e-3


def test_pipeline_rejects_text_that_is_right_only_by_threes(spark):
    """As op3_quality: the stage's model was of classes with contexts of two characters, by which such a text passed."""
    import corpus_pipeline

    words = lexicon(2)
    rows = [(i, prose(words, 400 + i, i), "en") for i in range(80)]
    rows.append((100, by_threes(" ".join(t for _, t, _ in rows), 1500, 7), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()} == set(range(80))
    assert 100 in {r.doc_id for r in quality(docs, context=0).where("kept").collect()}  # classes can't tell
