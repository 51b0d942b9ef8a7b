"""Smoothing in place for any split, weak tails, the next quiet place, windows that hold a point, and broken tracks among others."""

import numpy as np
import pytest

from intervalia import plans
from intervalia.operators import matching as M
from intervalia.operators import profiles as R
from intervalia.operators.scans import affine

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_affine(spark, size):
    rng = np.random.default_rng(5)
    rows = [(t, i, float(a), float(b)) for t in range(4) for i, (a, b) in enumerate(rng.random((rng.integers(1, 30), 2)))]
    want, y = {}, {}
    for t, i, a, b in rows:
        y[t] = a * y.get(t, 0.0) + b
        want[t, i] = round(y[t], 9)
    assert {(r.track, r.i): round(r.y, 9) for r in affine(spark.createDataFrame(rows, "track bigint, i bigint, a double, b double"), "i", size).collect()} == want


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_smoothing_in_place(spark, size):
    levels = [3.0, 9.0, 1.0, 7.0, 7.0, 2.0, 8.0, 4.0]
    frames = spark.createDataFrame([(1, k, k * 5.0 + 1, v) for k, v in enumerate(levels)], "track bigint, idx bigint, t double, value double")
    tracks = spark.createDataFrame([(1, 40.0)], "track bigint, duration double")
    rows = R.profile(R.windows(frames, tracks, 10.0), 0.3, 0.5, size).orderBy("window").collect()
    x = [0.3 + 0.5 * r.complexity for r in rows]
    for i in range(len(x)):
        x[i] = 0.7 * x[i] + 0.3 * float(np.mean(x[max(0, i - 1) : i + 2]))
    assert len(rows) == 8 and np.allclose(x, [r.threshold for r in rows])
    at = R.window_at(spark.createDataFrame([(1, 1, 5.0), (1, 2, 4.0), (1, 3, 99.0), (2, 4, 1.0)], "track bigint, point bigint, t double"), R.profile(R.windows(frames, tracks, 10.0), 0.3, 0.5), 0.4, 10.0)
    assert [(r.point, r.window) for r in at.orderBy("point").collect()] == [(1, 0), (2, 0), (3, None), (4, None)]


def test_weak_tails(spark):
    rows = [(1, 0, 0.0, 20.0, True, 1.0, 2.0), (1, 1, 20.0, 21.0, True, 0.1, 0.3), (1, 2, 21.0, 30.0, False, 0.0, 0.0), (1, 3, 30.0, 31.0, True, 0.5, 0.3), (1, 4, 31.0, 40.0, False, 0.1, 0.1), (1, 5, 40.0, 41.0, True, 0.0, 0.0), (2, 0, 0.0, 1.0, True, 0.0, 0.0), (2, 1, 1.0, 9.0, False, 0.0, 0.0)]
    got = R.absorb_weak_tails(spark.createDataFrame(rows, "track bigint, seg bigint, start double, end double, human boolean, rms double, peak double"), 5.0)
    assert [(r.track, r.seg, r.start, r.end, r.human) for r in got.orderBy("track", "seg").collect()] == [
        (1, 0, 0.0, 20.0, True), (1, 1, 20.0, 30.0, False), (1, 2, 30.0, 31.0, True), (1, 3, 31.0, 40.0, False), (1, 4, 40.0, 41.0, True), (2, 0, 0.0, 1.0, True), (2, 1, 1.0, 9.0, False),
    ]
    assert plans.queries()["weak_tails"](spark, SF).where("absorbed").count() > 0


def test_next_quiet(spark):
    frames = spark.createDataFrame([(1, k, v) for k, v in enumerate([-10.0, -50.0, -10.0, -10.0, -50.0, -10.0])], "track bigint, frame bigint, db double")
    points = spark.createDataFrame([(1, 1, 0.05), (1, 2, 0.15), (1, 3, 0.25), (1, 4, 0.55), (1, 5, 7.0), (1, 6, -1.0), (2, 7, 1.0)], "track bigint, point bigint, t double")
    assert [(r.point, round(r.quiet, 9)) for r in R.next_quiet(points, frames, 0.1, 0.05, 2.0).orderBy("point").collect()] == [(1, 0.1), (2, 0.15), (3, 0.4), (4, -1.0), (5, 7.0), (6, -1.0), (7, 1.0)]


def test_segment_lyrics(spark):
    segments = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 10.0, 20.0), (1, 2, 20.0, 30.0), (1, 3, 30.0, 30.0)], "track bigint, seg bigint, start double, end double")
    words = spark.createDataFrame([(1, "again", 4.0, 5.0), (1, "hello", 1.0, 2.0), (1, "edge", 9.0, 11.0), (1, "most", 9.5, 12.0), (1, "歌", 21.0, 22.0), (1, "声", 22.0, 23.0)], "track bigint, text string, start double, end double")
    got = M.segment_lyrics(segments, words).orderBy("seg").collect()
    assert [(r.text, r.first, r.last, r.words) for r in got] == [("hello again edge", 1.0, 11.0, 3), ("edge most", 9.0, 12.0, 2), ("歌声", 21.0, 23.0, 2), (None, None, None, 0)]
