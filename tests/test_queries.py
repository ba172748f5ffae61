"""Each registered query with SQL against DuckDB on the smallest tables; those without against plain Python."""

import decimal
from pathlib import Path

import duckdb
import pytest

import foliate.plans.dossier
import foliate.plans.reports
import foliate.plans.queries  # noqa: F401  both register
from foliate.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    return round(float(v), 9) if isinstance(v, float | decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    rows = lambda got, at: sorted(repr(tuple(plain(r[x]) for x in at)) for r in got)
    order = sorted(names)
    assert rows(df.collect(), order) == rows(want.fetchall(), [names.index(c) for c in order])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def split_long(part, limit):
    out = []
    while len(part) > limit:
        at = part[: limit + 1].rfind(" ")
        at = at if at > 0 else limit
        out.append(part[:at].strip(" "))
        part = part[at:].strip(" ")
    return [x for x in [*out, part] if x]


def test_chunks(spark, duck):
    want = []
    for doc_id, text in duck.execute("select doc_id, text from documents").fetchall():
        parts = [p for line in text.splitlines() if line.strip(" ") for p in split_long(line.strip(" "), 4000)]
        done, cur = [], []
        for p in parts:
            if cur and len("\n".join([*cur, p])) > 4000:
                done.append("\n".join(cur))
                cur = []
            cur.append(p)
        want += [(doc_id, i, c) for i, c in enumerate([*done, "\n".join(cur)] if cur else done)]
    got = [tuple(r) for r in QUERIES["chunk_documents"](spark, SF).select("doc_id", "chunk_index", "chunk").collect()]
    assert sorted(got) == sorted(want)
    assert max(len(c) for _, _, c in got) <= 4000


def test_batch_packing(spark, duck):
    rows = duck.execute("select source, list(greatest(1, ceil(length(text) / 4))::int order by doc_id) from documents group by 1").fetchall()
    want = []
    for source, sizes in rows:
        done, cur = [], []
        for n in sizes:
            if cur and sum(cur) + n > 16_000:
                done.append(cur)
                cur = []
            cur.append(n)
        want += [(source, i, len(b), ",".join(map(str, b))) for i, b in enumerate([*done, cur])]
    assert sorted(map(tuple, QUERIES["batch_packing"](spark, SF).collect())) == sorted(want)
