"""The driver's contract, and that the optional part may be absent."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.queries import ORACLE_SQL, QUERIES, K

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in frame.collect()]
    if name not in ORACLE_SQL:
        assert len(got) == K  # held against brute force in the tests of their operators
        return
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(names) == sorted(frame.columns)
    order = [names.index(c) for c in frame.columns]
    key = lambda rows: sorted(str([plain(v) for v in r]) for r in rows)
    assert key(got) == key([[r[k] for k in order] for r in want])


@pytest.mark.parametrize("name", ["stream_ingest", "stream_event_counts"])
def test_streams_over_tables_of_many_files(spark, duck, tmp_path, name):
    for t in ("conversations", "events"):
        spark.read.parquet(f"{DATA}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    frame = QUERIES[name](spark, str(tmp_path))
    key = lambda rows: sorted(str([plain(v) for v in r]) for r in rows)
    assert key(frame.collect()) == key(duck.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLE_SQL[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rrf_hybrid' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})


def test_nothing_else_needs_the_optional_part():
    for p in ROOT.rglob("*.py"):
        part = p.relative_to(ROOT).parts
        if "llm" not in part and part[0] not in ("__spark_entry__.py", "corpus_pipeline.py") and p.name != "test_entry.py":
            assert "tessera.llm" not in p.read_text() and "import llm" not in p.read_text(), p
