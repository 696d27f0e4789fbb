"""Registered queries beside their SQL twin; TABLEQUARRY_ALL=1 runs all of them at sf0.001."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_sql import compare

FOLDER = os.environ.get("TABLEQUARRY_DATA", "/root/testdata/sf0.001")
SOME = ["a2_slot_batch", "e5_clauses", "f4_in", "g1_mask_literals", "j7_cell_links", "k7_reranked", "s1_marked_tables", "w7_document_number", "x7_cut_pair"]
NAMES = list(entry.queries()) if os.environ.get("TABLEQUARRY_ALL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for path in glob.glob(os.path.join(FOLDER, "*.parquet")):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    text, _, good = compare(spark, con, name, FOLDER)
    assert good, text


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [["tablequarry/llm"], ["corpus_pipeline.py"], ["tablequarry/llm", "corpus_pipeline.py"]])
def test_core_without_corpus_parts(tmp_path, gone):
    """A copy without the corpus operators, the pipeline or both still names all core queries."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for part in ("tablequarry", "__spark_entry__.py", "corpus_pipeline.py"):
        if part in gone or not os.path.exists(source := os.path.join(root, part)):
            continue
        copy = shutil.copytree if os.path.isdir(source) else shutil.copy
        options = {"ignore": shutil.ignore_patterns("__pycache__", *[os.path.basename(g) for g in gone])} if os.path.isdir(source) else {}
        copy(source, tmp_path / part, **options)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    from tablequarry.plans import QUERIES

    assert set(QUERIES) <= set(done.stdout.split())
    assert "pipeline" not in done.stdout.split()
