"""Queries against their SQL on small tables with rare rows, which the given tables don't hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from intervalia import plans
from intervalia.operators import matching as M
from intervalia.operators import pauses as P
from intervalia.operators.folds import fold

from .test_oracles import rows


def same(spark, folder, name, events):
    """events: (event_id, microseconds, user_id, event_type, value)."""
    columns = "event_id bigint, us bigint, user_id bigint, event_type string, value double"
    spark.createDataFrame(events, columns).coalesce(1).select("event_id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, us / 1000000)").alias("ts"), "user_id", "event_type", "value").write.parquet(f"{folder}/events.parquet")
    df = plans.queries()[name](spark, str(folder))
    got = rows([r.asDict() for r in df.collect()], df.columns)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    found = con.sql(plans.oracle_sql()[name])
    assert got == rows([dict(zip(found.columns, r)) for r in found.fetchall()], found.columns)
    return got


def test_positions_that_fall_together(spark, tmp_path):
    # In hours * 1000: of the second track the candidates 3600 + 4 and 3604 + 0 are one position.
    events = [(n, n * 3600000000, 1, "view", 1.0) for n in range(6)] + [(10 + n, at * 3600000, 2, "view", 1.0) for n, at in enumerate([0, 10, 20, 3600, 3604, 3700])]
    got = same(spark, tmp_path, "positional_difference", events)
    assert len(got) == 11
    sides = [spark.createDataFrame([(1, s) for s in samples], "track bigint, sample bigint") for samples in ([5, 9], [7])]
    assert [tuple(r) for r in M.positional_difference(*sides, 1000, strict=False).collect()] == [(1, 1, 2.0)]
    with pytest.raises(Exception, match="different counts"):
        M.positional_difference(*sides, 1000).collect()


def test_paths_that_are_equally_good(spark, tmp_path):
    # Two paths differ by rounding alone, which follows the last bits of the deviation of the onsets.
    tracks = [
        [185.7, 74.54, 94.59, 29.82, 58.07, 129.13, 30.82, 26.08, 56.6, 65.16, 44.43, 41.23, 31.05, 50.21, 264.18, 5.5, 12.53, 82.0, 4.79, 9.64, 96.38, 17.99, 21.63, 44.16, 0.74, 75.27, 19.61, 27.96, 17.6, 64.71, 2.1, 292.06, 88.62, 78.27, 48.92, 81.15, 52.21, 29.24, 66.36, 35.99, 8.06, 59.24, 6.9, 112.27, 3.68, 17.28, 5.4, 6.53, 26.02, 22.35, 15.2, 16.33, 17.87, 29.67, 100.73, 48.48, 15.14, 8.98, 73.13, 128.64, 85.95, 53.09, 31.07, 33.32, 53.28, 49.04, 19.42, 6.54, 127.55, 46.7, 17.26, 18.7, 31.12],
        [0.18, 23.6, 52.41, 30.56, 47.95, 99.38, 6.19, 19.15, 17.85, 106.87, 20.66, 26.27, 11.72, 116.32, 21.67, 75.8, 12.02, 17.67, 23.91, 8.64, 17.88, 91.14, 10.7, 29.56, 1.0, 2.02, 118.08, 62.73, 9.77, 8.85, 32.04, 55.23, 24.88, 1.78, 8.71, 26.88, 37.49, 18.55, 0.05, 16.52, 19.24, 96.48, 6.75, 304.52, 42.66, 24.13, 122.19, 14.72, 37.44, 30.2, 17.39, 38.41, 20.58, 62.32, 0.69, 30.27, 174.01, 12.85, 1.55, 2.39, 80.3, 78.55, 45.7, 36.7, 288.7, 68.44, 55.73, 2.15, 67.93, 86.45, 21.98, 65.66, 9.72, 84.13, 13.6, 34.94],
    ]
    events = [(100 * track + n, n * 1000000, track, "view", value) for track, values in enumerate(tracks) for n, value in enumerate(values)]
    got = same(spark, tmp_path, "beat_track", events)
    assert ("50.0000", "0.0000") in got and ("31.0000", "1.0000") in got


@pytest.mark.parametrize("parts", [1, 5])
def test_levels_of_pauses_are_added_in_one_order(spark, parts):
    # (40.71 + 54.77) + 22.72 gives 39.4, the other way round a little more; a pause of 39.4 alone comes before it then.
    values = [200.0, 40.71, 54.77, 22.72, 200.0, 39.4, 200.0, 200.0]
    frames = spark.createDataFrame([(1, n + 1, 3.0 * n, v, 0.5) for n, v in enumerate(values)], "track bigint, idx bigint, t double, value double, flatness double").repartition(parts, "idx")
    pauses = P.valley_pauses(frames, 0.4, 0.9, 2.0, 24.0)
    assert [(r.start, r.energy) for r in pauses.orderBy("start").collect()] == [(3.0, 39.400000000000006), (15.0, 39.4)]
    kept = P.cap_valleys(pauses, spark.createDataFrame([(1, 21.0)], "track bigint, duration double"), 96.0)
    assert [r.start for r in kept.collect()] == [15.0]


def test_groups_stay_whole_where_a_join_becomes_a_broadcast(spark):
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        rows = spark.range(400000, numPartitions=8).selectExpr("id % 10 as track", "id as n")
        few = spark.range(3).selectExpr("id as track", "id as more")
        counts = fold(rows.join(few, "track", "left"), ["track"], ["n"], lambda x: [x["track"][:1], [len(x["n"])]], "track bigint, n bigint")
        assert sorted(map(tuple, counts.collect())) == [(k, 40000) for k in range(10)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
