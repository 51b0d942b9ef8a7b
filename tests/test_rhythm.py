"""Tempo and beats: clicks at a known tempo, and tracks cut into blocks of any size."""

import numpy as np
import pytest

from intervalia.operators import rhythm


def _clicks(spark, n, period, seed=0, track=1):
    rng = np.random.default_rng(seed)
    v = rng.random(n) * 0.2
    v[3::period] += 1 + rng.random(len(v[3::period]))
    return spark.createDataFrame([(track, i, float(x)) for i, x in enumerate(v)], "track bigint, idx bigint, value double")


def test_clicks(spark):
    onsets = _clicks(spark, 400, 10)
    tempo = rhythm.tempo(rhythm.lag_products(onsets, 6, 40), 0.05)
    assert (tempo.first().period, tempo.first().bpm) == (10, 120.0)
    found = [r.idx for r in rhythm.beats(onsets, tempo).orderBy("idx").collect()]
    assert found == list(range(3, 400, 10))
    features = rhythm.tempo_features(rhythm.beats(onsets, tempo).selectExpr("track", "idx * 0.05 as t"), tempo).first()
    assert (round(features.stability, 6), features.category) == (1.0, "fast")


@pytest.mark.parametrize("size", [64, 100, 333])
def test_blocks_give_the_same(spark, size):
    rng = np.random.default_rng(size)
    noise = spark.createDataFrame([(2, i, float(x)) for i, x in enumerate(rng.random(1000) ** 4)], "track bigint, idx bigint, value double")
    zero = spark.createDataFrame([(3, i, 0.0) for i in range(300)], "track bigint, idx bigint, value double")
    onsets = _clicks(spark, 900, 13).unionByName(noise).unionByName(zero)
    whole, parts = rhythm.lag_products(onsets, 6, 40), rhythm.lag_products(onsets, 6, 40, size)
    assert [(r.track, r.lag, round(r["product"], 9)) for r in whole.orderBy("track", "lag").collect()] == [(r.track, r.lag, round(r["product"], 9)) for r in parts.orderBy("track", "lag").collect()]
    tempo = rhythm.tempo(whole, 0.05)
    assert {r.track for r in tempo.collect()} == {1, 2}
    assert sorted(map(tuple, rhythm.beats(onsets, tempo).collect())) == sorted(map(tuple, rhythm.beats(onsets, tempo, size=size).collect()))


def test_onset_strength(spark):
    frames = spark.createDataFrame([(1, 5, 2.0), (1, 6, 5.0), (1, 7, 1.0)], "track bigint, idx bigint, value double")
    assert [(r.idx, r.value) for r in rhythm.onset_strength(frames).orderBy("idx").collect()] == [(0, 0.0), (1, 3.0), (2, 0.0)]
    empty = frames.limit(0)
    assert rhythm.beats(rhythm.onset_strength(empty), rhythm.tempo(rhythm.lag_products(empty, 6, 40), 0.05)).count() == 0
