import importlib.util
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and all(map(callable, q.values()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in ("orders", "lineitem"):
        c.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    want = sorted(c.execute(entry.oracle_sql()["pgm_pair_marginal"]).fetchall())
    got = sorted(map(tuple, entry.entry(spark).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_imports_without_the_corpus_subpackage(tmp_path):
    """A copy without the subpackage, its tests and its pipeline still imports and offers the other queries."""
    for root, _, names in os.walk(os.path.join(HERE, "netquill")):
        at = os.path.relpath(root, HERE)
        if "llm" in at.split(os.sep):
            continue
        os.makedirs(tmp_path / at, exist_ok=True)
        for n in names:
            if n.endswith(".py"):
                (tmp_path / at / n).write_bytes(open(os.path.join(root, n), "rb").read())
    (tmp_path / "__spark_entry__.py").write_bytes(open(os.path.join(HERE, "__spark_entry__.py"), "rb").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(k.startswith('op2_') for k in q); print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no corpus pipeline")
def test_a_missing_dependency_leaves_only_the_corpus_queries_out():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": HERE})
    assert done.returncode == 0 and "public_tokenizers" in done.stderr, done.stderr


def test_nothing_else_imports_the_corpus_subpackage():
    for root, _, names in os.walk(os.path.join(HERE, "netquill")):
        if "llm" in os.path.relpath(root, HERE).split(os.sep):
            continue
        for n in names:
            if n.endswith(".py"):
                assert "netquill.llm" not in open(os.path.join(root, n), encoding="utf-8").read(), n
    assert importlib.util.find_spec("netquill.plans.catalogue")
