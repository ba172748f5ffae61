"""Files as rows: archives, word-processor documents, strings of unknown formats, task lists and folders.

Files come as Spark's ``binaryFile`` rows (path, content, length). What has a
format is read by a small function for each file, in Arrow batches; the rest is
expressions. A null or broken content gives no rows and no error, unless said.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from foliate.functions import labels

#: Endings of files that can be read, and how.
READERS = {".docx": "docx", ".zip": "zip", ".txt": "text", ".mpp": "strings", ".pdf": "page text", ".png": "recognition", ".jpg": "recognition", ".jpeg": "recognition", ".tif": "recognition", ".tiff": "recognition"}
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def binary_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, content) of the files at ``path``, folders below included."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path).select("path", "length", "content")


def reader_of(path: Column) -> Column:
    """IO1: how a file is read, by its ending; null for one that is not."""
    ending = F.concat(F.lit("."), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))
    return F.create_map(*[F.lit(v) for kv in READERS.items() for v in kv])[ending]


def ascii_strings(content: Column, least: int = 4) -> Column:
    """IO8: runs of ``least`` printable ASCII characters, tabs or line ends or more."""
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(rf"[\t\n\r\x20-\x7e]{{{least},}}"), F.lit(0))


@F.arrow_udf(ArrayType(StringType()))
def _utf16_runs(content: pa.Array, least: pa.Array) -> pa.Array:
    def runs(data: bytes, n: int) -> Iterator[str]:
        for at in (0, 1):
            text = data[at : len(data) - (len(data) - at) % 2].decode("utf-16-le", "surrogatepass")
            run = ""
            for c in [*text, "\0"]:
                if c in "\t\n\r " or c <= "\uffff" and c.isprintable() and not c.isspace():
                    run += c
                    continue
                if len(run) >= n:
                    yield run
                run = ""

    return pa.array([None if x is None else list(runs(x, n)) for x, n in zip(content.to_pylist(), least.to_pylist(), strict=True)], pa.list_(pa.string()))


def utf16_strings(content: Column, least: int = 4) -> Column:
    """IO9: such runs of printable characters in UTF-16, low byte first, from the first byte on and then from the second.

    Half-pairs are no characters; they end a run. Spark's own decoding refuses
    them, so the bytes are read by a small function.
    """
    return _utf16_runs(content, F.lit(least))


def safe_member(name: Column) -> Column:
    """IO10: a member's path without empty, dot and parent parts; empty for no name."""
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")


def zip_members(files: DataFrame, endings: tuple[str, ...] = (".pdf", ".docx", ".txt", ".png", ".jpg"), most_files: int = 250, most_member: int = 50 << 20, most_bytes: int = 300 << 20) -> DataFrame:
    """IO10: (path, member, size, reason, content) of each file in archives (path, content), in their order.

    A member without a name, with another ending or over ``most_member`` bytes has
    a reason and no content. An archive of more than ``most_files`` files, or that
    would outgrow ``most_bytes``, gives one row with that reason, and so does one
    that cannot be read.
    """
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("reason", pa.string()), ("content", pa.binary())])

    def expand(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                infos = [i for i in archive.infolist() if not i.is_dir()]
                good = [i for i in infos if i.filename.lower().endswith(endings) and i.file_size <= most_member]
                if len(infos) > most_files or sum(i.file_size for i in good) > most_bytes:
                    yield path, None, None, "too many files" if len(infos) > most_files else "too many bytes", None
                    return
                for i in infos:
                    reason = "format" if not i.filename.lower().endswith(endings) else "size" if i.file_size > most_member else None
                    yield path, i.filename, i.file_size, reason, None if reason else archive.read(i)
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
            yield path, None, None, "not readable", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for row in expand(path, content.as_py()):  # a batch for each member bounds the memory
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)

    out = files.select("path", "content").mapInArrow(run, "path string, name string, size long, reason string, content binary")
    member = safe_member(F.col("name"))
    return out.select("path", member.alias("member"), "size", F.when(F.col("reason").isNull() & (member == ""), "name").otherwise(F.col("reason")).alias("reason"), "content")


def docx_blocks(files: DataFrame) -> DataFrame:
    """IO4: (path, block, kind, table, row, text) of documents (path, content): paragraphs and table rows, in order.

    A row's cells are joined by " | ", empty ones left out; blocks without text
    go, but count. A table's rows share its block. Broken files give no rows.
    """
    schema = pa.schema([("path", pa.string()), ("block", pa.int32()), ("kind", pa.string()), ("table", pa.int32()), ("row", pa.int32()), ("text", pa.string())])
    said = lambda e: "".join("\t" if x.tag == f"{WORD}tab" else "\n" if x.tag in (f"{WORD}br", f"{WORD}cr") else x.text or "" for x in e.iter() if x.tag in (f"{WORD}t", f"{WORD}tab", f"{WORD}br", f"{WORD}cr"))

    def blocks(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{WORD}body")
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return
        n = tables = 0
        for e in body if body is not None else ():
            if e.tag == f"{WORD}p":
                n += 1
                if text := said(e).strip():
                    yield path, n, "paragraph", None, None, text
            elif e.tag == f"{WORD}tbl":
                n, tables = n + 1, tables + 1
                for k, row in enumerate(e.iter(f"{WORD}tr"), 1):
                    cells = [" ".join(" ".join(said(p) for p in cell.iter(f"{WORD}p")).split()) for cell in row.findall(f"{WORD}tc")]
                    if text := " | ".join(x for x in cells if x):
                        yield path, n, "row", tables, k, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if rows := [dict(zip(schema.names, r, strict=True)) for r in blocks(path, content.as_py())]:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(run, "path string, block int, kind string, table int, row int, text string")


# Names under which task lists give a task's fields.
TASK_NAMES = {"name": ["name", "task_name", "title"], "start": ["start", "start_date"], "finish": ["finish", "end", "finish_date"], "duration": ["duration"]}


def tasks(rows: DataFrame, text_col: str, names: dict[str, list[str]] = TASK_NAMES) -> DataFrame:
    """IO7: a row for each task of a JSON object's "tasks" (task_no and ``names``): of a field's names the first that is there and not empty."""
    held = F.from_json(F.get_json_object(text_col, "$.tasks"), "array<map<string,string>>")
    x = rows.select(*[c for c in rows.columns if c != text_col], F.posexplode(held).alias("task_no", "task"))
    value = lambda ns: F.coalesce(*[F.nullif(F.trim(F.col("task")[n]), F.lit("")) for n in ns])
    return x.select(*[c for c in x.columns if c != "task"], *[value(ns).alias(n) for n, ns in names.items()])


def renamed(files: DataFrame, suffix: str) -> DataFrame:
    """Files with the ending of their path replaced."""
    return files.withColumn("path", labels.with_suffix(F.col("path"), suffix))
