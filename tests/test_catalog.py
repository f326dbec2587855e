"""Every query with SQL of its own gives the rows that DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest

from gatehouse import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="sample tables are absent")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = [tuple(f"{r[k]:.9g}" if isinstance(r[k], float) and math.isfinite(r[k]) else r[k] for k in order) for r in data]
    return sorted(clean, key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    found = db.execute(catalog.oracles()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_every_rule_has_a_query():
    from gatehouse.plans.rulespec import rule_names

    assert len(rule_names()) == 107
    covered = {q.removeprefix("rule_").removesuffix("_2") for q in catalog.queries() if q.startswith("rule_")}
    assert set(rule_names()) <= covered
