"""Folds: exact whole numbers, groups over many batches, groups that raise."""

import numpy as np
import pytest

from intervalia.operators import candidates
from intervalia.operators.folds import NONE, fold


def test_large_ids_beside_tracks_without_candidates(spark):
    ids = [(1 << 60) + 1, (1 << 60) + 3]
    c = spark.createDataFrame([(2, ids[0], 5.0, 0.9), (2, ids[1], 10.0, 0.8)], "track bigint, cand_id bigint, t double, value double")
    tracks = spark.createDataFrame([(1, 15.0), (2, 15.0), (3, 15.0)], "track bigint, duration double").coalesce(1)
    got = candidates.optimal(c, tracks, 3.0, 8.0, (4.0, 7.0), 0.5).where("role = 'cut'").orderBy("ord").collect()
    assert [(r.track, r.cand_id) for r in got] == [(2, ids[0]), (2, ids[1])]
    assert candidates.optimal(c, tracks, 3.0, 8.0, (4.0, 7.0), 0.5).where("track != 2 and cand_id is not null").count() == 0


@pytest.mark.parametrize("rows_a_batch", [1, 3, 7, 10_000])
def test_groups_over_batches_and_errors(spark, rows_a_batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        rows = spark.range(60).selectExpr("case when id % 6 = 5 then null else id % 6 + (1l << 60) end as k", "id", "if(id % 7 = 0, null, id * (1l << 50)) as v")

        def step(x):
            if x["k"][0] == (1 << 60) + 2:
                raise ValueError("broken")
            assert (np.diff(x["id"]) > 0).all()
            v = x["v"][x["v"] != NONE]
            return [x["k"][:1], np.array([len(x["id"])]), np.array([v.sum()])]

        got = {r.k: r for r in fold(rows, ["k"], ["id"], step, "k bigint, n bigint, v bigint", error="error").collect()}
        assert len(got) == 6
        broken = got.pop((1 << 60) + 2)
        assert (broken.n, broken.v, broken.error) == (None, None, "ValueError: broken")
        for k in range(6):
            if k != 2:
                r = got[None] if k == 5 else got[(1 << 60) + k]
                own = [i for i in range(60) if i % 6 == k]
                assert (r.n, r.v, r.error) == (len(own), sum(i << 50 for i in own if i % 7), None)
        with pytest.raises(Exception, match="broken"):
            fold(rows, ["k"], ["id"], step, "k bigint, n bigint, v bigint").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
