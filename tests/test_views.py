"""The declared schemas are those of the files, and unused dimensions are not joined."""

import pytest

from metricloom.sources import views as V


@pytest.mark.parametrize("name", list(V.SCHEMAS))
def test_declared_schema(spark, sf, name):
    stored = spark.read.parquet(f"{sf}/{name}.parquet")
    assert V.table(spark, sf, name).dtypes == stored.dtypes


def test_only_needed_tables_are_joined(spark, sf, capsys):
    V.sales(spark, sf, ["quantity", "revenue"]).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and plan.count("FileScan") == 1
    full = V.sales(spark, sf)
    assert full.count() == V.table(spark, sf, "lineitem").count()
