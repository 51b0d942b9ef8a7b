"""Pitch: a tone that moves, and blocks of any size."""

import numpy as np
import pytest

from intervalia.operators import pitch as P
from intervalia.operators.finalise import wave_chunks

L = P.Lags(8000.0, 128, 40, 20, 80)


@pytest.fixture(scope="module")
def waves(spark):
    hz = np.concatenate([np.full(2000, 200.0), np.full(2000, 250.0)])
    tone = np.sin(2 * np.pi * np.cumsum(hz) / 8000)
    noise = np.random.default_rng(4).standard_normal(1500)
    return spark.createDataFrame([(1, tone.tolist()), (2, noise.tolist()), (3, [0.0] * 400), (4, [1.0] * 50), (5, [])], "track bigint, samples array<double>")


def test_tone(waves):
    rows = P.pitch_contour(wave_chunks(waves, 400, L.halo, ("samples",)), L, 400).orderBy("track", "frame").collect()
    own = [r for r in rows if r.track == 1]
    assert len(own) == (4000 - L.halo) // 40 + 1 and all(r.voiced for r in own if r.frame < 40 or r.frame > 52)
    assert {r.lag for r in own if r.frame < 40} == {40} and {r.lag for r in own if r.frame > 52} == {32}
    assert not any(r.voiced for r in rows if r.track in (2, 3))
    assert {r.track for r in rows} == {1, 2, 3}


@pytest.mark.parametrize("size, block", [(40, 1), (400, 7), (2000, 30)])
def test_blocks_give_the_same(waves, size, block):
    def rows(size, block):
        return sorted((r.track, r.frame, r.lag, r.voiced) for r in P.pitch_contour(wave_chunks(waves.where("track != 3"), size, L.halo, ("samples",)), L, size, block=block).collect())

    assert rows(size, block) == rows(4000, P.SIZE)
