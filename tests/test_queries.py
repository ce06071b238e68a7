"""Each registered query of the library runs at the smallest scale and gives what its SQL gives."""

import math
from pathlib import Path

import pytest

from offerlens import plans
from offerlens.plans import answers, audits, composed, dialogues, evaluation, matching, offers, questions, records, tables, texts, topics, vocabulary  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = [p.stem for p in sorted(Path(SF).glob("*.parquet"))]


def plain(v):
    if v is None or isinstance(v, (bool, str, int)):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_against_its_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    rows, columns = got.collect(), sorted(got.columns)
    if name not in plans.ORACLE:
        return
    run = duck.execute(plans.ORACLE[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in run.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == want
