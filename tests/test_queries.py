"""Every registered query against its SQL in another engine."""

import math
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd
import pytest

from tidegauge import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    """Columns and rows of every query, or its error; several at a time, for most of a small query is planning."""

    def run(name):
        try:
            df = q.queries()[name](spark, sf_dir)
            return df.columns, [tuple(r) for r in df.collect()]
        except Exception as e:
            return e

    names = sorted(q.queries())
    with ThreadPoolExecutor(6) as pool:
        return dict(zip(names, pool.map(run, names)))


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_against_sql(results, duck, name):
    if isinstance(results[name], Exception):
        raise results[name]
    names, data = results[name]
    found = duck.cursor().execute(q.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(names) == sorted(columns)
    assert rows(names, data) == rows(columns, found.fetchall())
