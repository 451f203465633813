"""Every query with SQL against it, on the smallest tables; plans of the main ones."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from entwine import pool_queries  # noqa: F401
from entwine import queries as q
from entwine.operators import blocking


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple(None if x is None or x != x else x.item() if hasattr(x, "item") else x for x in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_sql(spark, sf, con, name):
    got, want = q.queries()[name](spark, sf).toPandas(), con.execute(q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


SMALL = blocking.Caps(name=1, name_token=3, number=1, address=1, address_token=2, budget=3)


@pytest.mark.parametrize("what", ["pruned", "kept"])
def test_caps_that_bind_equal_sql(spark, sf, con, what):
    recs = q.View(spark, sf).recs
    got = {
        "pruned": blocking.oversized(blocking.candidate_postings(recs), SMALL),
        "kept": blocking.budgeted(blocking.candidates(recs, SMALL), SMALL),
    }[what].toPandas()
    sql = {"pruned": "SELECT country, ch AS channel, key, size FROM big", "kept": "SELECT s1_id, cand_id, mask FROM cand"}[what]
    want = con.execute(f"WITH {q._blocks(SMALL)} {sql}").df()
    assert len(got) and rows(got) == rows(want)


def test_plans_have_no_nested_loops_and_push_down(spark, sf):
    for name in ("candidates_budget", "rule_scores", "policy_c", "fast_baseline_matches"):
        plan = q.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
        assert "source" not in plan.split("ReadSchema:")[1].split(">")[0]  # unused columns are not read
    assert "WindowGroupLimit" in q.queries()["policy_c"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_the_rest_imports_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/entwine", tmp_path / "entwine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) == len(q.Q)


def test_a_broken_subpackage_is_not_hidden(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/entwine", tmp_path / "entwine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import a_package_that_is_not_there")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode != 0 and "a_package_that_is_not_there" in out.stderr
