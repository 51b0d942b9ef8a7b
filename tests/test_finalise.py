"""The finalising chain: a quiet gap is found, chunks of any size give the same, tracks without waves and points."""

import numpy as np
import pytest

from intervalia.operators import finalise as Z

M = Z.Moves(rate=1000.0, crossing=8, reach=150, window=10, guard_db=2.0, floor_db=-40.0)
POINTS = "track bigint, point bigint, t double, score double"


@pytest.fixture(scope="module")
def waves(spark):
    t = np.arange(6000) / 1000
    vocal = np.sin(2 * np.pi * 110 * t) * np.where((t > 2.05) & (t < 2.12), 0.0005, 1.0)
    mix = vocal + 0.0001 * np.sin(2 * np.pi * 7 * t)
    noise = np.random.default_rng(1).standard_normal((2, 3000)) * np.repeat(np.random.default_rng(2).choice([0.001, 1.0], 60), 50)
    return spark.createDataFrame([(1, vocal.tolist(), mix.tolist()), (2, noise[0].tolist(), noise[1].tolist())], "track bigint, vocal array<double>, mix array<double>")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(1, 1, 2.0, 0.9), (1, 2, 2.3, 0.5), (1, 3, 0.2, 0.8), (1, 4, 5.9, 0.7), (1, 5, 9.0, 0.9), (3, 1, 1.0, 1.0)]
    return spark.createDataFrame(rows + [(2, k, float(x), float(s)) for k, (x, s) in enumerate(rng.random((20, 2)) * [3, 1])], POINTS)


def test_quiet_gap(spark, waves, points):
    boundaries, adjusted, suppressed = Z.finalise(points.where("track = 1"), Z.wave_chunks(waves, 500, M.halo), 500, M, 0.5, 0.3)
    cut = adjusted.collect()
    assert len(cut) == 1 and cut[0].raw == 2.0 and 2.05 < cut[0].final < 2.12 and abs(cut[0].final_shift_ms - 1000 * (cut[0].final - 2.0)) < 1e-9
    assert [r["sample"] for r in boundaries.where("track = 1").orderBy("sample").collect()] == [0, round(cut[0].final * 1000), 6000]
    assert [r.point for r in suppressed.collect()] == [2]


@pytest.mark.parametrize("size", [37, 400, 10_000])
def test_chunks_give_the_same(waves, points, size):
    def rows(n):
        return [sorted(tuple(round(v, 9) for v in r) for r in df.collect()) for df in Z.finalise(points, Z.wave_chunks(waves, n, M.halo), n, M, 0.1, 0.3, per_window=2, window=1.0)]

    assert rows(size) == rows(6000)
    assert not any(r[0] == 3 for r in rows(size)[0])


def test_nothing(waves, points):
    boundaries, adjusted, suppressed = Z.finalise(points.limit(0), Z.wave_chunks(waves, 500, M.halo), 500, M, 0.5, 0.3)
    assert sorted((r.track, r["sample"]) for r in boundaries.collect()) == [(1, 0), (1, 6000), (2, 0), (2, 3000)]
    assert adjusted.count() == suppressed.count() == 0
