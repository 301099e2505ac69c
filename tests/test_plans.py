"""Plan properties of every registered query."""
import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cartesian_or_nested_loop_join(spark, name):
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_prunes_columns(spark):
    df = E.queries()["e10_retrieval_recall"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the label column of the embeddings table is never read for retrieval
    assert "label" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_callable_and_native_encoders_agree(spark):
    import numpy as np
    from corpusmill.operators import infer as INF
    from corpusmill.plans import views
    docs = views.documents(spark, SF).select("doc_id", "text")
    a = {r.doc_id: r.vec for r in INF.embed(docs, "text", lambda: INF.hashed_bow_encoder(64)).collect()}
    b = {r.doc_id: r.vec for r in INF.hashed_bow(docs, "doc_id", "text", 64).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k] is None) == (b[k] is None)
        if a[k] is not None:
            assert np.allclose(a[k], b[k], atol=1e-6)
