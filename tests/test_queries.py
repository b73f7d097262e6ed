"""Every query of the engine against its SQL; the training-data operators have tests of their own."""

import math

import duckdb
import pytest

from tesserae.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(rows):
    cell = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted(str(tuple(cell(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sf_dir, db, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    found = db.execute(registry.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in found.fetchall()]
    assert plain(map(tuple, df.select(*cols).collect())) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_table_grid_has_every_cell(spark, sf_dir):
    rows = registry.QUERIES["table_grid"](spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert rows.count() == 2 * (lines.count() + lines.select("l_orderkey").distinct().count())


def test_optional_parts_that_cannot_be_imported(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "tesserae.llm.registry", None)  # as if it needed a module that isn't there
    assert set(__spark_entry__.queries()) == set(registry.QUERIES) and set(__spark_entry__.oracle_sql()) == set(registry.ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_views(spark, sf_dir):
    from tesserae.plans.analytics import create_views

    for name in create_views(spark, sf_dir):
        assert spark.sql(f"SELECT * FROM {name}").count() > 0


def test_filters_reach_the_scan(spark, sf_dir):
    plan = registry.QUERIES["optional_filters"](spark, sf_dir)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "o_orderpriority" in plan.split("PushedFilters")[1].split("\n")[0]
    assert "o_totalprice" not in plan.split("ReadSchema")[1].split("\n")[0]
