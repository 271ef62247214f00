"""Every registered query against its SQL, and rules that hold for all physical plans."""

from threading import Barrier

import pytest

import __spark_entry__ as driver
from check import compare, connect
from sparkfeat.registry import ORACLES, QUERIES, models

TRAINING = {
    "gbt_scores", "importances", "split_importances", "unimportant_features", "cv_report",
    "random_search", "score_like",
}


# Facts about trained models; their plans end in the same scoring step.
FACTS = {
    "gbt_score_facts", "gbt_planted", "importance_facts", "unimportant_planted", "cv_report_facts",
    "random_search_facts", "score_like_facts", "score_like_decisions", "out_of_fold_planted",
    "tree_root", "tree_node_facts",
}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_sql_or_trains_a_model():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == TRAINING


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, con, name):
    assert compare(QUERIES[name](spark, small), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(ORACLES) - FACTS))
def test_plan_has_no_cross_join_and_no_python(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert operator not in plan


def test_scores_are_probabilities_and_repeatable(spark, small):
    one = {r.doc_id: r.score for r in QUERIES["gbt_scores"](spark, small).collect()}
    two = {r.doc_id: r.score for r in QUERIES["gbt_scores"](spark, small).collect()}
    assert one == two and one and all(0 <= s <= 1 for s in one.values())


def test_every_registered_query_is_offered():
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


def test_entry_runs(spark):
    out = driver.entry(spark)
    assert out.count() == spark.read.parquet(f"{driver.SMOKE_DIR}/customer.parquet").count()


@pytest.mark.parametrize("missing", ["public_tokenizers", "xxhash", "sparkfeat.llm", "corpus_pipeline"])
def test_other_queries_are_offered_without_a_library_of_the_corpus_operators(missing):
    """A fresh interpreter in which a module cannot be found."""
    import subprocess
    import sys

    code = f"""
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r} or name.startswith({missing!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name}}", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as driver
from sparkfeat.registry import QUERIES
assert set(driver.queries()) == set(QUERIES), set(driver.queries()) ^ set(QUERIES)
print("offered")
"""
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True)
    assert out.stdout.strip().endswith("offered"), out.stderr[-500:]


def test_trainings_of_several_seeds_run_at_once(spark, small, monkeypatch):
    """Both trainings of one table wait for each other, and each gives the model of its seed alone."""
    table = models._planted_table(spark, small)
    one_by_one = [models._trained(table, "answer", **models.PLANTED, seed=s) for s in (314, 315)]
    meeting, train = Barrier(2, timeout=60), models.M.train

    def met(*arguments):
        meeting.wait()
        return train(*arguments)

    monkeypatch.setattr(models.M, "train", met)
    at_once = models._trained_with(table, (314, 315), "answer", **models.PLANTED)
    assert [m.stages[-1].toDebugString.split("\n", 1)[1] for m in at_once] == [
        m.stages[-1].toDebugString.split("\n", 1)[1] for m in one_by_one
    ]
