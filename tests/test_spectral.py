"""Spectra: a pure tone, silence, and chunks of any size."""

import numpy as np
import pytest

from intervalia.operators import spectral as X
from intervalia.operators.finalise import wave_chunks

F = X.Frames(8000.0, 64, 16)


@pytest.fixture(scope="module")
def waves(spark):
    t = np.arange(2000) / 8000
    rows = [(1, np.sin(2 * np.pi * 1000 * t).tolist()), (2, [0.0] * 100), (3, np.random.default_rng(1).standard_normal(1024).tolist()), (4, [0.5]), (5, []), (6, None)]
    return spark.createDataFrame(rows, "track bigint, samples array<double>")


def at(waves, size):
    return wave_chunks(waves, size, F.size // 2, ("samples",))


def test_tone_and_silence(waves):
    middle = X.spectral_features(at(waves, 160), F, 160).where("track = 1 and frame = 60").first()
    assert abs(middle.centroid - 1000) < 1 and middle.rolloff == 1125.0 and middle.flatness < 0.01
    pitch = X.chroma(X.spectra(at(waves, 160), F, 160).where("track = 1 and frame = 60"), F).orderBy("power", ascending=False).first()
    assert (pitch.pitch, pitch.power) == (11, 1.0)  # 1000 Hz is next to B
    silent = X.spectral_features(at(waves, 160), F, 160).where("track = 2").collect()
    assert len(silent) == 7 and {(r.centroid, r.bandwidth, r.rolloff, round(r.flatness, 9)) for r in silent} == {(0.0, 0.0, 0.0, 1.0)}
    assert X.vocal_features(at(waves, 160), F, 160).where("track = 2 and harmonic + clarity > 0").count() == 0
    assert sorted({r.track for r in X.spectra(at(waves, 160), F, 160).select("track").distinct().collect()}) == [1, 2, 3, 4]


@pytest.mark.parametrize("of", [X.spectral_features, X.vocal_features, X.spectra, lambda c, f, s: X.cepstra(c, f, s, 20)])
def test_chunks_give_the_same(waves, of):
    def rows(size):
        flat = lambda v: tuple(round(x, 9) for x in v) if isinstance(v, list) else round(v, 9)
        return sorted(tuple(flat(v) for v in r) for r in of(at(waves, size), F, size).collect())

    whole = rows(4096)
    assert rows(16) == whole and rows(480) == whole
    assert len([r for r in whole if r[0] == 3]) == 1024 // 16 + 1


def test_chunks_must_hold_hops(waves):
    with pytest.raises(ValueError):
        X.spectra(at(waves, 100), F, 100)
