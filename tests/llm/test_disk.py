"""What line dedup has on disk: nothing shuffled outlives its step, and lines do not travel with their substrings."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import foliate.llm.line_dedup as lines
from foliate.llm.shared import cut


def letters(n, seed):
    return "".join(random.Random(seed).choices("abcdefghij", k=n))


def given(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return cut(lines.lines_of(df, "doc_id", "text").select(F.xxhash64("line").alias("h"), "line", F.length("line").alias("size")))


def shuffle_files(spark):
    """Those that hold more than a few sums."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in Path(d.getPath()).glob("*/shuffle_*.data") if f.stat().st_size > 1000}


def test_what_lines_have_shuffled_is_deleted(spark):
    """It stood there until the driver happened to collect its garbage, so that a long run had all its steps' files at once."""
    table = given(spark, ["\n".join(letters(60, k) for k in (i, i // 2 + 100)) for i in range(40)])
    before = shuffle_files(spark)
    links = lines.line_links(table, 2)
    for _ in range(30):  # deleted in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and not links.count()


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_lines_meet_without_their_texts(spark, monkeypatch, most):
    """Beyond the broadcast each line was shuffled once for each of its substrings."""
    monkeypatch.setattr(lines, "BROADCAST_ROWS", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the rows are too many
    texts = [letters(4000, i) for i in range(200)]
    table = given(spark, [t + "\n" + t[:900] + "k" + t[900:] if i < 20 else t for i, t in enumerate(texts)])
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    try:
        assert lines.line_links(table, 2).count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written() - before < 3 * sum(map(len, texts))
