"""Golden cases and invariants of operators without SQL, streaming and sources."""

import json

from intervalia import plans
from intervalia.operators import candidates, layout
from intervalia.sources import timelines
from intervalia.streaming import live

SF = "/root/testdata/sf0.001"


def test_plan_golden(spark):
    c = spark.createDataFrame([(1, 1, 4.0, 0.8), (1, 2, 10.0, 0.9), (1, 3, 16.0, 0.7)], "track bigint, cand_id bigint, t double, score double")
    tracks = spark.createDataFrame([(1, 20.0), (2, 21.0)], "track bigint, duration double")
    got = candidates.plan(c, tracks, 3.0, 8.0, (4.0, 7.0)).orderBy("track", "ord").collect()
    assert [r.t for r in got if r.track == 1] == [0, 4, 10, 16, 20]
    assert [r.t for r in got if r.track == 2] == [0, 7, 14, 21]


def test_suppression_keeps_a_gap(spark):
    kept = plans.queries()["score_suppression"](spark, SF).orderBy("track", "t").collect()
    assert all(b.t - a.t >= 6 - 1e-5 for a, b in zip(kept, kept[1:]) if a.track == b.track)


def test_layout_tiles(spark):
    rows = plans.queries()["segment_layout"](spark, SF).orderBy("track", "seg").collect()
    for a, b in zip(rows, rows[1:]):
        assert a.end <= a.start + 80 + 1e-5
        assert (b.start == 0) if a.track != b.track else abs(a.end - b.start) < 1e-5


def test_layout_merges(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 10.0, "human"), (1, 1, 10.0, 11.0, "music"), (1, 2, 11.0, 16.0, "human")], "track bigint, seg int, start double, end double, kind string")
    assert [(r.start, r.end) for r in layout.refine(s, 2.0, 5.0, 12.0).orderBy("seg").collect()] == [(0.0, 10.0), (10.0, 16.0)]


def test_timelines(spark, tmp_path):
    doc = {"track": 1, "words": [{"word": "hello", "start_ms": 500, "start": 9, "end_s": 0.9, "confidence": 0.95}, {"token": " ", "start": 2, "end": 1}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    rows = timelines.items(timelines.read_timelines(spark, str(tmp_path)), "words", offset=10.0)
    first = rows.where("text = 'hello'").first()
    assert (first.start, first.end) == (10.5, 10.9)
    assert timelines.invalid(rows).first().reason == "order,text"
    timelines.write_timelines(rows, str(tmp_path / "out"))


def test_stream_equals_batch(spark, tmp_path):
    frames = spark.sql("select timestamp_seconds(1700000000 + id * 600) as ts, id % 3 as track, cast(id as double) as value from range(50)")
    frames.write.parquet(str(tmp_path / "in"))
    stream = live.windowed_levels(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("levels").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(spark.table("levels").collect()) == sorted(live.windowed_levels(frames).collect())


def _levels(spark, duration, hop, values):
    n = int(duration / hop) + 1
    return spark.createDataFrame([(1, k * hop, float(values.get(k, 1.0))) for k in range(n)], "track bigint, t double, value double")


def _borders(segments):
    return [round(r.end, 1) for r in segments.orderBy("seg").collect()][:-1]


def _two(spark):
    return spark.createDataFrame([(1, 0.0, 30.0, "human"), (1, 30.0, 35.0, "music")], "track bigint, start double, end double, kind string")


def test_layout_splits_at_a_quiet_phrase_border(spark):
    times = lambda *t: spark.createDataFrame([(1, x) for x in t], "track bigint, a double")
    limits = layout.Limits(soft_max=15.0)
    valley = {39: 0.08, 40: 0.01, 41: 0.08}
    assert 20.1 in _borders(layout.lay_out(_two(spark), limits, frames=_levels(spark, 35.0, 0.5, valley), phrases=times(20.1)))
    assert _borders(layout.lay_out(_two(spark), limits, frames=_levels(spark, 35.0, 0.5, {}), phrases=times(15.0))) == [30.0]
    words = spark.createDataFrame([(1, 19.8, 20.2)], "track bigint, start double, end double")
    both = _borders(layout.lay_out(_two(spark), limits, frames=_levels(spark, 35.0, 0.5, valley | {43: 0.12, 44: 0.05, 45: 0.12}), phrases=times(22.0), words=words))
    assert 22.0 in both and 20.0 not in both
    assert _borders(layout.lay_out(_two(spark), layout.Limits(soft_max=15.0, midpoint=True))) == [15.0, 30.0]


def test_layout_merges_what_splits_left_over(spark):
    s = spark.createDataFrame([(1, 0.0, 21.95, "human"), (1, 21.95, 23.31, "human"), (1, 23.31, 26.47, "music")], "track bigint, start double, end double, kind string")
    values = {}
    for valley in (9.68, 20.70):
        at = round(valley / 0.05)
        for k in range(at - 20, at + 21):
            values[k] = min(values.get(k, 1.0), 0.01 + 0.4 * abs(k - at) / 20)
    got = layout.lay_out(s, layout.Limits(micro=2.0, soft_min=5.0, soft_max=12.0), frames=_levels(spark, 30.0, 0.05, values))
    assert [(round(r.start, 2), round(r.end, 2), r.kind) for r in got.orderBy("seg").collect()] == [(0.0, 9.7, "human"), (9.7, 21.95, "human"), (21.95, 26.47, "music")]


def test_layout_uses_suppressed_cuts_beats_and_the_least_gap(spark):
    cuts = spark.createDataFrame([(1, 11.0, 0.4), (1, 18.0, 0.9), (1, 29.9, 1.0)], "track bigint, t double, score double")
    assert _borders(layout.lay_out(_two(spark), layout.Limits(soft_max=15.0), suppressed=cuts.where("t < 29"))) == [11.0, 18.0, 30.0]
    assert _borders(layout.lay_out(_two(spark), layout.Limits(soft_max=15.0), suppressed=cuts)) == [30.0]  # the best one is too near an end, and used up
    beats = spark.createDataFrame([(1, 29.7), (1, 33.0)], "track bigint, a double")
    assert _borders(layout.lay_out(_two(spark), layout.Limits(snap=0.5), beats=beats)) == [29.7]
    short = spark.createDataFrame([(1, 0.0, 5.0, "human"), (1, 5.0, 5.5, "music_lib"), (1, 5.5, 6.0, "music"), (1, 6.0, 20.0, "human")], "track bigint, start double, end double, kind string")
    rows = layout.lay_out(short, layout.Limits(gap=1.0)).orderBy("seg").collect()
    assert [(r.start, r.end, r.kind) for r in rows] == [(0.0, 5.0, "human"), (5.0, 6.0, "music_lib"), (6.0, 20.0, "human")]


def test_full_layout_tiles(spark):
    rows = plans.queries()["full_layout"](spark, SF).orderBy("track", "seg").collect()
    for a, b in zip(rows, rows[1:]):
        assert (b.start == 0) if a.track != b.track else abs(a.end - b.start) < 1e-5


def test_folds_split_groups_at_batches(spark):
    """A group over several Arrow batches arrives whole, and many small ones in one stream stay apart."""
    from intervalia.operators.folds import fold

    rows = spark.sql("select if(id < 25000, 1L, id) as track, id as t from range(26000)")
    got = fold(rows, ["track"], ["t"], lambda x: [x["track"][:1], [len(x["t"])], [int(x["t"][0])]], "track bigint, n bigint, first bigint").collect()
    assert {(r.track, r.n, r.first) for r in got} == {(1, 25000, 0), *((k, 1, k) for k in range(25000, 26000))}


def test_files_in_and_out(spark, tmp_path):
    import hashlib

    from intervalia.sources import files

    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, raw in (("B.wav", b"two"), ("deep/a.mp3", b"one"), ("c.txt", b"no")):
        (tmp_path / "in" / name).write_bytes(raw)
    (tmp_path / "names.txt").write_text("# tracks\ndeep/a.mp3\n\nmissing.wav\n")
    found = files.listing(spark, str(tmp_path / "in"))
    assert sorted((r.size, r.sha256) for r in found.collect()) == [(3, hashlib.sha256(x).hexdigest()) for x in sorted((b"one", b"two"), key=lambda x: hashlib.sha256(x).hexdigest())]
    held, missing = files.listed(spark, str(tmp_path / "names.txt"), found)
    assert [r.path.endswith("/deep/a.mp3") for r in held.collect()] == [True] and [r.name for r in missing.collect()] == ["missing.wav"]
    c = spark.createDataFrame([(1, 2.0, 0.5, "beat"), (1, 1.0, 0.25, "breath")], "track bigint, t double, score double, source string")
    files.write_candidates(c, str(tmp_path / "c"))
    assert [x["t"] for x in spark.read.json(str(tmp_path / "c")).first().candidates] == [1.0, 2.0]
    files.write_review(c.select("track", "source"), str(tmp_path / "r"))
    back = spark.read.option("header", True).csv(str(tmp_path / "r"))
    assert tuple(back.columns) == files.REVIEW and back.count() == 2
    assert json.loads(c.select(files.request("track", "t", mode="fast")).first()[0])["mode"] == "fast"


def test_timeline_sources(spark):
    import pytest

    def broken(_):
        raise OSError("no server")

    found, reasons = timelines.first_available(spark, [broken, lambda s: timelines.nothing(s)])
    assert found.count() == 0 and reasons == "no server"
    assert timelines.first_available(spark, [broken])[1] == "no server"
    with pytest.raises(ValueError, match="off"):
        timelines.nothing(spark, "off", strict=True)


def test_interpolated_profiles(spark):
    from intervalia.operators import adaptation

    w = adaptation.profile_weights(spark.createDataFrame([(1, 85.0), (2, 200.0), (3, 30.0)], "track bigint, bpm double"))
    v = spark.createDataFrame([("ballad", "x", 1.0), ("pop", "x", 3.0), ("edm", "x", 9.0)], "profile string, name string, value double")
    assert {r.track: r.value for r in adaptation.interpolated(w, v).collect()} == {1: 2.0, 2: 9.0, 3: 1.0}


def test_layouts_compute_their_parts_once(spark):
    """Points are a work table, which no reading computes anew, and segments are no call of pandas for each track."""
    for name in ("full_layout", "segment_layout"):
        df = plans.queries()[name](spark, SF)
        assert df.inputFiles() and not any(f.endswith("events.parquet") for f in df.inputFiles())
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
