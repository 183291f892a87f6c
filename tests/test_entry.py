"""The entry points, with and without the subpackage for training data, and parity with SQL on the smallest tables."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
TABLES = "/root/testdata/sf0.001"
PARITY = ("gap_rank", "tally_minute", "feed_gap", "inauth_score", "weak_labels", "trust_state_final", "copy_pairs", "story_fold", "normalize_noaa", "canonical_url", "trust_replay", "knn_topk", "time_split", "primary_match", "stream_velocity", "inserted_once")


def test_imports_without_a_session_and_without_the_subpackage(tmp_path):
    for name in ("undertow", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 80 and set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "undertow").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "undertow.llm" not in path.read_text(encoding="utf-8"), path


def plain(rows):
    def one(v):
        return None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the supplied tables")
@pytest.mark.parametrize("name", PARITY)
def test_parity(spark, name):
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    for table in ("events", "documents", "embeddings", "pages", "labels", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    got = entry.queries()[name](spark, TABLES)
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain([[r[c] for c in columns] for r in got.collect()]) == plain(want[columns].astype(object).where(want[columns].notna(), None).values.tolist())
