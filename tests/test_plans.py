"""Every query of the library against its SQL, and the plans that must not hold a cross product."""

from __future__ import annotations

import importlib

import pytest

import __spark_entry__ as entry
from tests.compare import duck, duck_rows, rows_of

SF = "/root/testdata/sf0.001"
ALL = {name: pair for plan in entry.PLANS for name, pair in importlib.import_module(f"pressloom.plans.{plan}").QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, con, name):
    query, sql = ALL[name]
    got = rows_of(query(spark, SF))
    assert got[1] or name == "references"  # at this size nothing leads nowhere
    if sql is not None:
        assert got == duck_rows(con, sql)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["window_pairs", "set_alike", "bm25_top8", "cosine_top8"])
def test_no_cross_product(spark, name, capsys):
    ALL[name][0](spark, SF).explain()
    assert "CartesianProduct" not in capsys.readouterr().out
