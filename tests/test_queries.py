import os
import subprocess
import sys

import duckdb
import pytest

from quernel import plans
from tests.differ import assert_same, connection

SLOW = {"m3_classifiers", "n2_shapley_selection", "m2_time_series_cv", "g11_search", "m4_classifier_cv", "n1_probe_selection", "ts1_tree_scores", "m7_rules"}


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(name, spark, sf, duck):
    assert_same(plans.QUERIES[name](spark, sf), plans.SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL) - SLOW))
def test_rows(name, spark, sf):
    assert len(plans.QUERIES[name](spark, sf).take(1)) == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_training_data_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    import shutil

    shutil.copytree(f"{root}/quernel", tmp_path / "quernel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'd1_ks' in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_imports_the_training_data_folder():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(f"{root}/quernel"):
        if "/llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "quernel.llm" not in open(f"{folder}/{n}").read()


@pytest.mark.parametrize("excess", [-1e-5, 1e-5])
def test_icc_values_that_round_alike_are_a_tie(spark, tmp_path, excess):
    n = 100  # rows of a group; the mean square between groups is 1 + excess times that within
    d = ((2 * n / (2 * n - 2)) * (1 + excess) / (2 * n)) ** 0.5
    rows = [(g, m + x) for g, m in (("a", -d), ("b", d)) for x in (-1.0, 1.0) for _ in range(n // 2)]
    spark.createDataFrame(rows, "event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "e"))
    os.rename(next((tmp_path / "e").glob("part-*.parquet")), tmp_path / "events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert_same(plans.QUERIES["pr4_icc_top"](spark, str(tmp_path)), plans.SQL["pr4_icc_top"], duck)
