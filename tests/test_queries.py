"""Every query against its SQL in DuckDB, and rules on the sources."""

import ast
import pathlib

import pytest

from compare import difference, views
from tests.conftest import ROOT, SF
from ticktide.plans import artifacts, catalog  # noqa: F401  (artifacts adds queries to those of catalog)


@pytest.fixture(scope="module")
def duck():
    return views(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toArrow()
    if name in catalog.SQL:
        assert difference(got, duck.sql(catalog.SQL[name]).to_arrow_table()) == ""
    else:
        assert got.num_rows


def test_gaps_of_all_cursors(spark, duck):
    n = duck.sql("SELECT count(*) FROM events").fetchall()[0][0]
    got = catalog.QUERIES["drop_gap_all_cursors"](spark, SF)
    assert sorted(r.cursor for r in got.select("cursor").collect()) == list(range(n))


def test_subsequences_of_all_venues(spark):
    at = {}
    for r in catalog.QUERIES["venue_subsequences"](spark, SF).collect():
        at.setdefault(r.venue_id, []).append(r.position)
    assert sorted(at) == [1, 2, 3, 4] and all(sorted(p) == list(range(len(p))) for p in at.values())


def test_partitioning_does_not_matter(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    got = set()
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.add(tuple(sorted(map(tuple, catalog.QUERIES["replay_from_ts"](spark, SF).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(got) == 1


def test_seek_reaches_the_scan(spark, tmp_path):
    from tests.helpers import WARM, frame
    from ticktide.operators import order

    frame(spark, WARM).write.parquet(str(tmp_path / "r"))
    seen = order.seek(spark.read.parquet(str(tmp_path / "r")), 1200).select("exchange_ts", "price")
    plan = seen._jdf.queryExecution().explainString(seen._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(exchange_ts,1200)" in plan and "ReadSchema: struct<exchange_ts:bigint,price:bigint>" in plan


BANNED = {"time", "time_ns", "monotonic", "current_timestamp", "rand", "randn", "uuid", "hash", "monotonically_increasing_id", "localCheckpoint"}


def test_sources_are_deterministic():
    """No wall clock outside clock.py, no random functions, no seeded hashes."""
    for path in pathlib.Path(ROOT, "ticktide").rglob("*.py"):
        if path.name == "clock.py":
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Call):
                f = node.func
                name = f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", "")
                owner = getattr(getattr(f, "value", None), "id", "")
                assert not (name in BANNED and owner in ("F", "time", "")), f"{path}: {name}"


def test_no_row_functions():
    """No function is called for each row, no RDD: batches and expressions only."""
    for path in pathlib.Path(ROOT, "ticktide").rglob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            name = node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""
            assert name not in ("udf", "pandas_udf", "rdd", "mapPartitions", "foreachPartition", "applyInPandas"), f"{path}: {name}"


def test_nothing_imports_llm():
    for path in pathlib.Path(ROOT, "ticktide").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
