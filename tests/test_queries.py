"""Every query with SQL gives the rows of its SQL on the smallest tables; every other one runs."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from regesta.plans import domain, general, intake, work
from tools.compare import plain

FOLDER = Path("/root/testdata/sf0.001")
MODULES = (general, domain, intake, work)
QUERIES, SQL = ({k: v for m in MODULES for k, v in getattr(m, kind).items()} for kind in ("QUERIES", "SQL"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in FOLDER.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not FOLDER.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name in SQL:
        rel = con.sql(SQL[name])
        assert sorted(rel.columns) == columns
        order = [list(rel.columns).index(c) for c in columns]
        assert Counter(got) == Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def test_names_are_of_one_query():
    assert len(QUERIES) == sum(len(m.QUERIES) for m in MODULES) and SQL.keys() <= QUERIES.keys()


def test_core_does_not_know_llm():
    root = Path(__file__).resolve().parent.parent / "regesta"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "regesta.llm" not in p.read_text(), p
