"""Every query outside the llm subpackage against its SQL, on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from sievewright.plans import analytics, dataset, nested, relational, retrieval, storage, text, training, validation

MODULES = [text, analytics, dataset, relational, retrieval, storage, nested, training, validation]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(str(norm(x)) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("module,name", [(m, n) for m in MODULES for n in m.QUERIES], ids=lambda x: x if isinstance(x, str) else x.__name__.rpartition(".")[2])
def test_query(spark, data, con, module, name):
    df = module.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in module.SQL:
        return
    found = con.execute(module.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert rows == sorted((tuple(norm(r[i]) for i in places) for r in found.fetchall()), key=str)
