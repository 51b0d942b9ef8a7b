"""Spectra of waves in chunks (track, chunk, offset, length, samples with a halo; finalise.wave_chunks): overlapping frames times a fixed basis, a batch of frames at once, and figures of each frame's spectrum.

Frame f has its middle at sample f * hop; what lies before or behind the wave counts as silence. A chunk has the frames whose middle lies in it, the last one that at the wave's end too, so it needs a halo of half a
frame, and chunks of any size (a multiple of hop) give the same frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Frames that are multiplied at once.
_BATCH = 4096
#: Bands of a voice, of its fundamental and of its formants, in Hz; limit of fundamentals; how much of a spectrum lies under its roll-off. Fixed values.
BANDS = {"vocal": (80.0, 4000.0), "fundamental": (200.0, 1000.0), "formant": (1000.0, 3000.0)}
FUNDAMENTAL, HARMONICS, ROLLOFF = 500.0, 5, 0.85


@dataclass(frozen=True)
class Frames:
    """Samples a second, samples of a frame (even) and from one frame to the next."""

    rate: float
    size: int
    hop: int

    @property
    def frequencies(self) -> np.ndarray:
        return np.arange(self.size // 2 + 1) * (self.rate / self.size)

    def basis(self) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and sines under a Hann window, a column for each frequency."""
        k = np.arange(self.size)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * k / self.size)
        angle = 2 * np.pi / self.size * (k[:, None] * np.arange(self.size // 2 + 1)[None, :] % self.size)
        return window[:, None] * np.cos(angle), window[:, None] * np.sin(angle)


def framed(chunk: int, offset: int, length: int, samples: np.ndarray, frames: Frames, size: int) -> tuple[int, np.ndarray]:
    """Number of the chunk's first frame, and its frames as rows (a view)."""
    first = -(-chunk * size // frames.hop)
    last = length // frames.hop if (chunk + 1) * size >= length else ((chunk + 1) * size - 1) // frames.hop
    half = frames.size // 2
    begin, end = first * frames.hop - half, last * frames.hop + half
    inside = samples[max(0, begin - offset) : max(0, end - offset)]
    padded = np.concatenate([np.zeros(max(0, offset - begin)), inside])
    padded = np.concatenate([padded, np.zeros(max(0, end - begin - len(padded)))])
    return first, np.lib.stride_tricks.sliding_window_view(padded, frames.size)[:: frames.hop]


def by_frame(chunks: DataFrame, frames: Frames, size: int, of: Callable[[np.ndarray], dict[str, np.ndarray]], columns: str) -> DataFrame:
    """track, frame and columns: what of() makes of a batch of frames (rows of samples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                track, chunk, offset, length = (batch.column(c)[row].as_py() for c in ("track", "chunk", "offset", "length"))
                samples = batch.column("samples")[row].values.to_numpy(zero_copy_only=False).astype(np.float64)
                first, rows = framed(chunk, offset, length, samples, frames, size)
                for lo in range(0, len(rows), _BATCH):
                    made = of(rows[lo : lo + _BATCH])
                    n = len(rows[lo : lo + _BATCH])
                    arrays = [pa.array(v) if v.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel())) for v in made.values()]
                    yield pa.RecordBatch.from_arrays([pa.array([track] * n, pa.int64()), pa.array(first + lo + np.arange(n)), *arrays], names=["track", "frame", *made])

    if size % frames.hop or frames.size % 2:
        raise ValueError("chunks must hold whole hops, and frames an even number of samples")
    return chunks.select("track", "chunk", "offset", "length", "samples").mapInArrow(run, f"track bigint, frame bigint, {columns}")


def magnitudes(frames: Frames) -> Callable[[np.ndarray], np.ndarray]:
    cos, sin = frames.basis()
    return lambda rows: np.hypot(rows @ cos, rows @ sin)


def spectra(chunks: DataFrame, frames: Frames, size: int) -> DataFrame:
    """track, frame, magnitude: an array from 0 Hz to half the rate."""
    of = magnitudes(frames)
    return by_frame(chunks, frames, size, lambda rows: {"magnitude": of(rows)}, "magnitude array<double>")


def spectral_features(chunks: DataFrame, frames: Frames, size: int) -> DataFrame:
    """track, frame, centroid, bandwidth, rolloff (the first frequency under which lie 85 % of the magnitudes) and flatness (geometric over arithmetic mean of
    the powers). A silent frame has centroid, bandwidth and rolloff 0 and flatness 1."""
    of, hz = magnitudes(frames), frames.frequencies

    def figures(rows: np.ndarray) -> dict[str, np.ndarray]:
        m = of(rows)
        total = m.sum(1)
        share = m / np.where(total > 0, total, 1.0)[:, None]
        centroid = share @ hz
        bandwidth = np.sqrt((share * (hz - centroid[:, None]) ** 2).sum(1))
        rolloff = hz[(np.cumsum(m, 1) >= ROLLOFF * total[:, None]).argmax(1)]
        power = np.maximum(m * m, 1e-10)
        return {"centroid": centroid, "bandwidth": bandwidth, "rolloff": rolloff, "flatness": np.exp(np.log(power).mean(1)) / power.mean(1)}

    return by_frame(chunks, frames, size, figures, "centroid double, bandwidth double, rolloff double, flatness double")


def vocal_features(chunks: DataFrame, frames: Frames, size: int) -> DataFrame:
    """track, frame, the sums of magnitudes of the bands, clarity (the fundamental's share) and harmonic, the share of the first five multiples of a fundamental: the largest peak (higher than both neighbours and than a
    tenth of the maximum) at 500 Hz at most; multiples above half the rate count as the last frequency. Without such a peak it is 0."""
    of, hz = magnitudes(frames), frames.frequencies
    low = np.flatnonzero(hz <= FUNDAMENTAL)

    def figures(rows: np.ndarray) -> dict[str, np.ndarray]:
        m = of(rows)
        total = m.sum(1) + 1e-8
        bands = {name: m[:, (hz >= a) & (hz <= b)].sum(1) for name, (a, b) in BANDS.items()}
        peak = np.zeros(m.shape, bool)
        peak[:, 1:-1] = (m[:, 1:-1] > m[:, :-2]) & (m[:, 1:-1] > m[:, 2:]) & (m[:, 1:-1] >= 0.1 * m.max(1)[:, None])
        f0 = np.where(peak, m, -1.0)[:, low].argmax(1)
        harmonic = np.take_along_axis(m, np.minimum(f0[:, None] * np.arange(1, HARMONICS + 1), len(hz) - 1), 1).sum(1) / total
        return bands | {"clarity": bands["fundamental"] / total, "harmonic": np.where(peak[:, low].any(1), harmonic, 0.0)}

    return by_frame(chunks, frames, size, figures, ", ".join(f"{c} double" for c in [*BANDS, "clarity", "harmonic"]))


def mel_basis(frames: Frames, bands: int) -> np.ndarray:
    """Triangles of equal area over the mel scale (linear up to 1000 Hz, logarithmic above), a column for each band."""
    to_mel = lambda f: np.where(f < 1000.0, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000.0) * 27 / np.log(6.4))
    to_hz = lambda m: np.where(m < 15, m * 200 / 3, 1000.0 * np.exp((m - 15) * np.log(6.4) / 27))
    edge = to_hz(np.linspace(0.0, float(to_mel(np.array(frames.rate / 2))), bands + 2))
    hz = frames.frequencies[:, None]
    rise, fall = (hz - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - hz) / (edge[2:] - edge[1:-1])
    return np.maximum(0.0, np.minimum(rise, fall)) * (2.0 / (edge[2:] - edge[:-2]))


def cepstra(chunks: DataFrame, frames: Frames, size: int, bands: int = 128, kept: int = 13, range_db: float = 80.0) -> DataFrame:
    """track, frame, mfcc: the first cosine coefficients (orthonormal) of the powers in mel bands, in dB, at most range_db under the track's largest."""
    of, basis = magnitudes(frames), mel_basis(frames, bands)
    level = by_frame(chunks, frames, size, lambda rows: {"db": 10 * np.log10(np.maximum(of(rows) ** 2 @ basis, 1e-10))}, "db array<double>")
    most = level.groupBy("track").agg(F.max(F.array_max("db")).alias("_most"))
    k = np.arange(bands)
    cosines = np.cos(np.pi / bands * (k + 0.5)[:, None] * np.arange(kept)[None, :]) * np.sqrt(2.0 / bands)
    cosines[:, 0] /= np.sqrt(2.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            db = batch.column("db").flatten().to_numpy().reshape(-1, bands)
            out = np.maximum(db, batch.column("_most").to_numpy()[:, None] - range_db) @ cosines
            yield pa.RecordBatch.from_arrays([batch.column("track"), batch.column("frame"), pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * kept), pa.array(out.ravel()))], names=["track", "frame", "mfcc"])

    return level.join(most, "track").select("track", "frame", "db", "_most").mapInArrow(run, "track bigint, frame bigint, mfcc array<double>")


def chroma(spectrum: DataFrame, frames: Frames) -> DataFrame:
    """track, frame, pitch class (0 is C) and its power, of the largest 1: each frequency from the lowest note on counts for the nearest note of equal temperament."""
    notes = [int(round(12 * np.log2(f / 440.0) + 69)) % 12 if f >= 16.0 else None for f in frames.frequencies]
    x = spectrum.select("track", "frame", F.posexplode("magnitude").alias("bin", "m")).withColumn("pitch", F.array(*(F.lit(n).cast("int") for n in notes))[F.col("bin")])
    power = x.where("pitch is not null").groupBy("track", "frame", "pitch").agg(F.sum(F.col("m") * F.col("m")).alias("power"))
    most = F.max("power").over(Window.partitionBy("track", "frame"))
    return power.select("track", "frame", "pitch", F.when(most > 0, F.col("power") / most).otherwise(0.0).alias("power"))
