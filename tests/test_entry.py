import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from footfall.plans import maps, queries, streets  # noqa: F401

TOP = Path(__file__).resolve().parents[1]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_training_data_package(tmp_path):
    shutil.copytree(TOP / "footfall", tmp_path / "footfall", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[-1] == "False" and int(said.stdout.split()[-2]) > 30


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("empty")
    for path in Path("/root/testdata/sf0.001").glob("*.parquet"):
        spark.read.parquet(str(path)).limit(0).write.parquet(f"{top}/{path.name}")
    return str(top)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_empty_tables(spark, empty_tables, name):
    assert queries.QUERIES[name](spark, empty_tables).count() <= 25
