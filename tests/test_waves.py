"""Waves as files: round trips, foreign and damaged files, splits by bytes, failures."""

import os
import pickle
import struct
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from intervalia.sources.waves import _Reader, _Writer, peak_normalised, read_waves, segment_name, write_segments, write_waves

ROWS = "path string, chunk bigint, length bigint, samples array<double>, LENGTH_ string"


def files(folder):
    return sorted(os.path.relpath(os.path.join(at, n), folder) for at, _, names in os.walk(folder) for n in names)


def whole(rows):
    """path to all its samples, from chunks that follow each other."""
    out = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["chunk"])):
        got = out.setdefault(r["path"], [])
        assert r["offset"] * r["channels"] == len(got) or r["channels"] > 1
        got.extend(r["samples"])
    return out


def chunked(waves, size):
    return [(p, k, len(s), list(map(float, s[k * size : (k + 1) * size])), "x") for p, s in waves.items() for k in range(max(1, -(-len(s) // size)))]


@pytest.mark.parametrize("bits", [16, 24, 32])
@pytest.mark.parametrize("split,frames", [(1 << 26, 1 << 16), (777, 50), (64, 1)])
def test_round_trip(spark, tmp_path, bits, split, frames):
    rng = np.random.default_rng(bits)
    waves = {f"d{n % 3}/w{n}": rng.uniform(-1.2, 1.2, n) for n in (0, 1, 2, 49, 50, 51, 333)}
    folder = str(tmp_path / "out")
    write_waves(spark.createDataFrame(chunked(waves, 50), ROWS).repartition(5), folder, 8000, bits)
    assert files(folder) == sorted(f"{p}.wav" for p in waves)
    rows = read_waves(spark, folder, splitBytes=split, chunkFrames=frames).collect()
    assert {(r["rate"], r["channels"], r["bits"], r["error"]) for r in rows} == {(8000, 1, bits, None)}
    got = whole(rows)
    assert set(got) == {f"{p}.wav" for p in waves}
    for p, s in waves.items():
        assert len(got[f"{p}.wav"]) == len(s)
        assert np.abs(np.array(got[f"{p}.wav"]) - np.clip(s, -1, 1)).max(initial=0) <= 1.5 / (1 << (bits - 1))


def test_nulls_and_not_numbers_are_silence(spark, tmp_path):
    folder = str(tmp_path / "out")
    write_waves(spark.createDataFrame([("a", 0, 4, [None, float("nan"), 0.5, float("inf")], None), ("b", 0, 0, None, None)], ROWS), folder, 8, 16)
    got = whole(read_waves(spark, folder).collect())
    assert got == {"a.wav": [0.0, 0.0, pytest.approx(0.5, abs=1e-4), pytest.approx(1.0, abs=1e-4)], "b.wav": []}


def test_foreign_files(spark, tmp_path):
    left, right = np.arange(-50, 50) * 300, np.arange(50, -50, -1) * 200
    with wave.open(str(tmp_path / "stereo.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(44100)
        w.writeframes(np.stack([left, right], 1).astype("<i2").tobytes())
    with wave.open(str(tmp_path / "bytes.WAV"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000)
        w.writeframes(bytes([0, 128, 255]))
    real = np.array([0.25, -2.0], "<f4").tobytes()
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 3, 1, 100, 400, 4, 32)
    parts = struct.pack("<4sI", b"LIST", 3) + b"abc\0" + head + struct.pack("<4sI", b"data", 0xFFFFFFFF) + real + b"\1"  # an odd part, a size that isn't known, half a sample
    (tmp_path / "real.wav").write_bytes(b"RIFF" + struct.pack("<I", 0) + b"WAVE" + parts)
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x.wav").write_bytes(b"no wave")
    got = whole(read_waves(spark, str(tmp_path), splitBytes=100, chunkFrames=7).collect())
    assert got["stereo.wav"] == list((left + right) / 2 / 32768)
    assert got["bytes.WAV"] == [-1.0, 0.0, 127 / 128]
    assert got["real.wav"] == [0.25, -2.0]
    assert set(got) == {"stereo.wav", "bytes.WAV", "real.wav"}
    kept = whole(read_waves(spark, str(tmp_path / "stereo.wav"), channels="keep").collect())
    assert kept == {"stereo.wav": list(np.stack([left, right], 1).ravel() / 32768)}


def test_files_of_two_channels(spark, tmp_path):
    folder = str(tmp_path / "out")
    write_waves(spark.createDataFrame([("a", 0, 2, [0.5, -0.5, 0.25, 0.75], None)], ROWS), folder, 8, 24, channels=2)
    with wave.open(f"{folder}/a.wav") as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()) == (2, 3, 8, 2)
    (row,) = read_waves(spark, folder).collect()
    assert row["samples"] == pytest.approx([0.0, 0.5], abs=1e-6)


def test_damaged_files(spark, tmp_path):
    write_waves(spark.createDataFrame([("good", 0, 1, [0.5], None)], ROWS), str(tmp_path), 8, 16)
    good = (tmp_path / "good.wav").read_bytes()
    for name, content in {"empty": b"", "text": b"not a wave at all", "cut": good[:30], "headless": good[:12] + good[36:], "kind": good[:20] + b"\x55\0" + good[22:]}.items():
        (tmp_path / f"{name}.wav").write_bytes(content)
    rows = read_waves(spark, str(tmp_path), mode="PERMISSIVE", splitBytes=9).collect()
    assert {r["path"]: r["error"] is None for r in rows} == {"good.wav": True, **{f"{n}.wav": False for n in ("empty", "text", "cut", "headless", "kind")}}
    assert len(rows) == 6
    with pytest.raises(Exception, match="no RIFF wave"):
        read_waves(spark, str(tmp_path / "text.wav")).collect()


@pytest.mark.parametrize("rows,reason", [([("b", 1, 2, [0.1, 0.2])], "should come"), ([("b", 0, 3, [0.1])], "missing"), ([("b", 0, 1, [0.1, 0.2])], "should come"), ([("b", 0, 1, [0.1]), ("b", 0, 1, [0.1])], "should come"), ([("../b", 0, 1, [0.1])], "names no file"), ([(None, 0, 1, [0.1])], "names no file"), ([("b", 0, 1 << 33, [0.1])], "fit the format")])
def test_a_failed_job_leaves_no_file(spark, tmp_path, rows, reason):
    folder = str(tmp_path / "out")
    good = [(f"a{i}", 0, 1, [0.5], None) for i in range(8)]
    with pytest.raises(Exception, match=reason):
        write_waves(spark.createDataFrame([*good, *((*r, None) for r in rows)], ROWS), folder, 8)
    assert not os.path.exists(folder) or files(folder) == []


def test_modes_and_sql(spark, tmp_path):
    folder = str(tmp_path / "out")
    one = lambda p: spark.createDataFrame([(p, 0, 1, [0.5], None)], ROWS)
    write_waves(one("a"), folder, 8)
    write_waves(one("b"), folder, 8)
    assert files(folder) == ["a.wav", "b.wav"]
    write_waves(one("c"), folder, 8, mode="overwrite")
    assert files(folder) == ["c.wav"]
    spark.sql(f"create or replace temporary view kept_waves using wave options (path '{folder}')")
    assert [tuple(r) for r in spark.sql("select path, length, rate from kept_waves").collect()] == [("c.wav", 1, 8)]
    write_waves(one("c").where("false"), str(tmp_path / "none"), 8)
    assert read_waves(spark, str(tmp_path / "none")).count() == 0


def test_segments(spark, tmp_path):
    rows = [(7, 0, [0.5] * 20, True, False), (7, 1, [0.25] * 4, False, True), (8, 0, [], None, None)]
    named = write_segments(spark.createDataFrame(rows, "track bigint, piece int, samples array<double>, voiced boolean, library boolean"), str(tmp_path), 8, bits=16)
    want = ["7/segment_001_human_2.5.wav", "7/segment_002_music_lib_0.5.wav", "8/segment_001_human_0.0.wav"]
    assert sorted(r["path"] for r in named.collect()) == want == files(tmp_path)
    bare = spark.range(1).select(segment_name(F.lit(12), F.lit(False), F.lit(None).cast("double")).alias("n")).first()["n"]
    assert bare == "segment_012_music"


def test_peaks(spark):
    rows = [("a", 0, [0.5, -0.25]), ("a", 1, [-0.1]), ("b", 0, [0.0]), ("c", 0, [])]
    got = {(r["path"], r["chunk"]): r["samples"] for r in peak_normalised(spark.createDataFrame(rows, "path string, chunk bigint, samples array<double>")).collect()}
    assert got == {("a", 0): [1.0, -0.5], ("a", 1): [-0.2], ("b", 0): [0.0], ("c", 0): []}


def test_many_short_files_cost_the_driver_little(tmp_path):
    folder, n = str(tmp_path / "out"), 3000
    writer = _Writer({"path": folder, "rate": "8", "bits": "16"}, False)
    paths = [f"d{k // 3}/a\n{k}" for k in range(n)]
    tasks = [pa.RecordBatch.from_pydict({"path": p, "chunk": [0] * len(p), "length": [2] * len(p), "samples": [[0.5, -0.5]] * len(p)}) for p in (paths[:1000], paths[1000:])]
    messages = [writer.write(iter([t])) for t in tasks] + [writer.write(iter([]))]
    assert max(len(pickle.dumps(m)) for m in messages) < 500
    writer.commit(messages)
    assert files(folder) == sorted(f"{p}.wav" for p in paths)
    reader = _Reader({"path": folder})
    parts = reader.partitions()
    batches = [b for p in parts for b in reader.read(p)]
    assert len(parts) <= 4 and len(batches) <= 8
    assert sorted(p for b in batches for p in b["path"].to_pylist()) == files(folder)
    assert all(x == pytest.approx([0.5, -0.5], abs=1e-4) for b in batches for x in b["samples"].to_pylist())
