"""Scans over blocks against plain loops; blocks of any size give the same."""

import random

import numpy as np
import pytest

from intervalia.operators import strategies as S
from intervalia.operators.finalise import wave_chunks

BARS = "track bigint, bar bigint, start double, end double, kind string, high boolean, quiet boolean"


def tracks_of(rng, n):
    out = []
    for track in range(n):
        edge = np.concatenate([[0.0], np.cumsum(np.array(rng.choices([0.5, 1.0, 1.5, 2.0, 3.0], k=rng.randint(1, 60))))]).tolist()
        bars = [(track, k, a, b, rng.choice(["verse", "chorus", "chorus_peak"]), rng.random() < 0.5, rng.random() < 0.7) for k, (a, b) in enumerate(zip(edge, edge[1:]))]
        times = sorted({round(rng.uniform(0, edge[-1]), 2) for _ in range(rng.randint(0, 30))} | set(rng.sample(edge, min(len(edge), 3))))
        out.append((bars, times, edge[-1] - rng.choice([0.0, 0.3])))
    return out


@pytest.fixture(scope="module")
def given(spark):
    own = tracks_of(random.Random(11), 25)
    bars = spark.createDataFrame([b for x, _, _ in own for b in x], BARS)
    times = spark.createDataFrame([(k, t) for k, (_, ts, _) in enumerate(own) for t in ts], "track bigint, t double")
    tracks = spark.createDataFrame([(k, d) for k, (_, _, d) in enumerate(own)], "track bigint, duration double")
    return own, bars, times, tracks


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_density(given, size):
    own, bars, times, _ = given
    want = []
    for x, ts, _ in own:
        count, last = 0, 0.0
        for track, bar, _, end, kind, _, _ in x:
            count += 1
            cut = count >= (2 if "chorus" in kind else 4) or any(last < t <= end for t in ts if t > 0)
            want.append((track, bar, end, count, cut))
            if cut:
                count, last = 0, end
    silences = times.where("t > 0")
    assert sorted(map(tuple, S.density_marks(bars, silences, 4, 2, size).collect())) == sorted(want)


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
@pytest.mark.parametrize("per_cut, least", [(1, 0.7), (2, 2.0), (3, 5.0)])
def test_beat_only(given, size, per_cut, least):
    own, bars, times, tracks = given
    want = []
    for x, ts, duration in own:
        count, last = 0, 0.0
        for track, bar, start, end, _, high, quiet in x:
            count += 1
            hit = None
            if high:
                if count >= per_cut and end <= duration and end - last >= least and quiet:
                    hit = end
            else:
                hit = next((t for t in ts if start <= t < end and t > last + least), None)
                if hit is None and count >= 2 * per_cut and end <= duration and end - last >= least:
                    hit = end
            if hit is not None:
                want.append((track, bar, hit, high))
                count, last = 0, hit
    assert sorted(map(tuple, S.beat_only_marks(bars, times, tracks, per_cut, least, size).collect())) == sorted(want)


@pytest.mark.parametrize("size, block", [(64, 1), (200, 2), (5000, 1000)])
def test_valleys(spark, size, block):
    rng = np.random.default_rng(8)
    rate, radius, window, drop, least = 100.0, 20, 4, 3.0, 15
    waves = {k: rng.standard_normal(900) * np.repeat(rng.choice([0.01, 0.3, 1.0], 90), 10) for k in range(6)}
    cuts = {k: sorted({0, 900, *rng.integers(1, 900, 25).tolist()}) for k in waves}
    words = {k: [(t, t + 0.15) for t in np.sort(rng.random(8) * 9).tolist()] for k in waves}
    want = []
    for k, s in waves.items():
        at = list(cuts[k])
        for i in range(1, len(at) - 1):
            lo, hi = max(0, at[i] - radius), min(len(s), at[i] + radius)
            if hi - lo <= window:
                continue
            db = np.array([20 * np.log10(np.sqrt(np.mean(s[j : j + window] ** 2) + 1e-12) + 1e-12) for j in range(lo, hi - window + 1)])
            own = db[int(np.clip(at[i] - lo - window // 2, 0, len(db) - 1))]
            offer = lo + int(db.argmin()) + window // 2
            if own - db.min() >= drop and not any(a < offer / rate < b for a, b in words[k]) and at[i - 1] + least < offer < at[i + 1] - least:
                at[i] = offer
        want += [(k, n, a, b) for n, (a, b) in enumerate(zip(cuts[k], at))]
    assert any(a != b for _, _, a, b in want)
    chunks = wave_chunks(spark.createDataFrame([(k, s.tolist()) for k, s in waves.items()], "track bigint, samples array<double>"), size, radius + window, ("samples",))
    boundaries = spark.createDataFrame([(k, n, a) for k, c in cuts.items() for n, a in enumerate(c)], "track bigint, n bigint, at bigint")
    spoken = spark.createDataFrame([(k, a, b) for k, w in words.items() for a, b in w], "track bigint, start double, end double")
    assert sorted(map(tuple, S.valley_refined(boundaries, chunks, spoken, size, rate, radius, window, drop, least, block).collect())) == sorted(want)


def test_labels(spark):
    segments = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 2.0, 4.0), (1, 2, 4.0, 6.0)], "track bigint, seg bigint, start double, end double")
    frames = spark.createDataFrame([(1, 0.5, 1.0, 2.0), (1, 1.5, 1.0, 2.0), (1, 2.5, 0.1, 2.0), (1, 4.5, 0.5, None)], "track bigint, t double, vocal double, rest double")
    assert [(r.seg, r.kind) for r in S.ratio_labels(segments, frames).orderBy("seg").collect()] == [(0, "human"), (1, "music"), (2, "human")]


def test_grid(spark):
    bars = S.uniform_bars(spark.createDataFrame([(1, 10.0, 4.0), (2, 0.0, 4.0)], "track bigint, duration double, width double"))
    assert [(r.bar, r.start, r.end) for r in bars.orderBy("bar").collect()] == [(0, 0.0, 4.0), (1, 4.0, 8.0), (2, 8.0, 12.0)]
