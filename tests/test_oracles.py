"""Every query of the reference's operators against its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from scorespark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def nodes(plan):
    yield plan
    children = plan.children()
    for k in range(children.size()):
        yield from nodes(children.apply(k))


def one_row(plan):
    most = plan.maxRows()
    return most.isDefined() and most.get() <= 1


#: Queries with windows or products of tables that have few rows: the classes of a task; the bins and thresholds of a sweep.
FEW_ROWS = {"class_weights", "threshold_sweep_best"}


def check_plan(df, few_rows=False):
    """No row-wise Python; products of tables only with one row; windows over all rows only of ranges' totals, one row each."""
    execution = df._jdf.queryExecution()
    assert "BatchEvalPython" not in execution.executedPlan().toString()
    for node in nodes(execution.optimizedPlan()):
        kind = node.nodeName()
        if kind == "Join" and not few_rows and node.condition().isEmpty():
            sides = node.children()
            assert one_row(sides.apply(0)) or one_row(sides.apply(1)), node.toString()
        if kind == "Window" and not few_rows and node.partitionSpec().isEmpty():
            grouped = [n for n in nodes(node) if n.nodeName() == "Aggregate"]
            names = grouped[0].groupingExpressions().mkString(",") if grouped else "nothing"
            assert names.startswith("_p#") or one_row(node.children().apply(0)), node.toString()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, sf_dir, duck, name):
    got = plans.queries()[name](spark, sf_dir)
    check_plan(got, name in FEW_ROWS)
    want = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = rows(got.columns, map(tuple, got.collect())), rows(columns, want.fetchall())
    assert len(a) == len(b), f"{len(a)} rows, {len(b)} expected"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not wrong, f"{len(wrong)} of {len(a)} rows differ, first {wrong[:3]}"


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert plans.queries()[name](spark, sf_dir).count() > 0
