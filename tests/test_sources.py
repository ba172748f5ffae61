"""Readers and streams on small files of known content."""

import io
import zipfile

from pyspark.sql import functions as F

from foliate.sources import files
from foliate.streaming import usage

BODY = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>First</w:t></w:r><w:r><w:t xml:space="preserve"> part</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>b  c</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Last</w:t></w:r></w:p></w:body></w:document>'


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_docx_blocks_keep_their_order(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(zipped(**{"word/document.xml": BODY}))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    rows = files.docx_blocks(files.binary_files(spark, str(tmp_path))).orderBy("block", "row").collect()
    assert [(r.block, r.kind, r.table, r.row, r.text) for r in rows] == [(1, "paragraph", None, None, "First part"), (3, "row", 1, 1, "a | b  c".replace("  ", " ")), (4, "paragraph", None, None, "Last")]


def test_zip_members(spark):
    good = zipped(**{"a/../x.txt": "hello", "b.exe": "no", "..": "dots", "c.pdf": "p" * 30})
    df = spark.createDataFrame([("1", good), ("2", b"broken"), ("3", None), ("4", zipped(**{f"{k}.txt": "x" for k in range(5)}))], "path string, content binary")
    got = sorted(((r.path, r.member or "", r.reason or "", bytes(r.content or b"")) for r in files.zip_members(df, most_files=4, most_member=20).collect()))
    assert got == [("1", "", "format", b""), ("1", "a/x.txt", "", b"hello"), ("1", "b.exe", "format", b""), ("1", "c.pdf", "size", b""), ("2", "", "not readable", b""), ("3", "", "not readable", b""), ("4", "", "too many files", b"")]


def test_strings_of_unknown_files(spark):
    content = b"\x00\x01abcd\x02xyz\x00\x00\x00" + "Projekti é".encode("utf-16-le") + b"\x00\x00"
    r = spark.createDataFrame([(content,)], "content binary").select(files.ascii_strings(F.col("content")).alias("a"), files.utf16_strings(F.col("content")).alias("u")).first()
    assert r.a == ["abcd"] and "Projekti é" in r.u


def test_tasks_and_readers(spark):
    text = '{"tasks": [{"name": "A", "start_date": "1.1.2020"}, {"title": "B", "name": " ", "end": "x"}]}'
    df = spark.createDataFrame([(1, text), (2, "no"), (3, None)], "id int, body string")
    assert [tuple(r) for r in files.tasks(df, "body").orderBy("task_no").collect()] == [(1, 0, "A", "1.1.2020", None, None), (1, 1, "B", None, "x", None)]
    kinds = spark.createDataFrame([("a/b.DOCX",), ("c",), ("x.pdf",)], "p string").select(files.reader_of(F.col("p"))).collect()
    assert [r[0] for r in kinds] == ["docx", None, "page text"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "2024-01-01 00:10:00", 5), (2, "u", "2024-01-01 00:50:00", 7), (2, "u", "2024-01-01 00:51:00", 9)], "id int, who string, at string, n int")
    rows.select("id", "who", F.col("at").cast("timestamp").alias("at"), "n").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, who string, at timestamp, n int").parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name).collect()

    used = run(usage.sliding_usage(stream, "who", "at", "n", "1 hour", "30 minutes"), "complete", "used")
    assert sorted((str(r.start)[11:16], r.requests, r.tokens) for r in used) == [("00:00", 3, 21), ("00:30", 2, 16), ("23:30", 1, 5)]
    assert sorted(r.id for r in run(usage.once(stream, "id", "at"), "append", "once")) == [1, 2]


def test_synced_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1, "one", "active"), ("b", 4, "two", "active")], "k string, version_number int, name string, status string").write.parquet(str(tmp_path / "v0"))
    spark.createDataFrame([("a", "changed", "uno", 1), ("a", "unchanged", "eins", 2), ("b", "deleted", None, 3), ("c", "new", "tri", 4)], "k string, change string, name string, seq int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, change string, name string, seq int").parquet(str(tmp_path / "in"))
    usage.synced(stream, lambda: spark.read.parquet(str(tmp_path / "v0")), lambda df: df.write.mode("overwrite").parquet(str(tmp_path / "v1")), "k", str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "v1")).collect())) == [("a", 1, "eins", "active"), ("b", 4, "two", "source_deleted"), ("c", 1, "tri", "active")]
