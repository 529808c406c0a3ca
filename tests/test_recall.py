"""The registered index searches find what the exact search finds."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from nearfield import queries

DATA = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_trained_search_reaches_its_recall(spark):
    exact = {q: {r.id for r in rows} for q, rows in by_query(queries.knn_batch(spark, str(DATA)), 5).items()}
    found = by_query(queries.ivf_trained_search(spark, str(DATA)), 5)
    assert exact.keys() == found.keys()
    assert sum(len(exact[q] & {r.id for r in found[q]}) for q in exact) / (5 * len(exact)) >= 0.9
    assert queries.ivf_trained_recall_report(spark, str(DATA)).agg(F.avg("recall")).first()[0] >= 0.9
    assert queries.diagnose_ivf_trained(spark, str(DATA)).first().recall >= 0.9
    assert {r.id for r in queries.ivf_trained_search_one(spark, str(DATA)).collect()} == {r.id for r in found[0]}


def by_query(df, k):
    out = {}
    for r in df.where(F.col("rank") <= k).collect():
        out.setdefault(r.query_id, []).append(r)
    return out
