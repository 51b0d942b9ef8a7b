"""Spans merged over a stream against the merge of the whole table."""

import random

import pytest

from intervalia.operators.intervals import merge
from intervalia.plans.exchange import streamed
from intervalia.streaming.spans import merged_spans

FORM = "track bigint, start double, end double"


def key(rows):
    return sorted((r["track"] if r["track"] is not None else -1, r["start"], r["end"], r["n"]) for r in rows)


def made(seed, n=120):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, None]), round(t := rng.uniform(0, 100), 3), round(t + rng.choice([0.0, 0.2, 1.0, 9.0]), 3)) for _ in range(n)]
    return [*rows, rows[0], rows[0]]


class Feed:
    """A folder that a stream reads file by file, in the order of putting."""

    def __init__(self, spark, base):
        self.spark, self.base = spark, str(base)

    def put(self, rows):
        self.spark.createDataFrame(rows, FORM).coalesce(1).write.mode("append").parquet(f"{self.base}/in")

    def run(self, gap, late):
        stream = self.spark.readStream.schema(FORM).option("maxFilesPerTrigger", 1).parquet(f"{self.base}/in")
        q = merged_spans(stream, gap, late).writeStream.format("parquet").option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start(f"{self.base}/out")
        q.awaitTermination()
        return self.spark.read.schema(f"{FORM}, n bigint").parquet(f"{self.base}/out").collect()


CLOSE = [(None, 1e6, None)]


@pytest.mark.parametrize("seed,gap,late", [(1, 0.0, "200 seconds"), (2, 0.3, "200 seconds")])
def test_any_order_of_batches(spark, tmp_path, seed, gap, late):
    rows, feed = made(seed), Feed(spark, tmp_path)
    for i in range(0, len(rows), 41):
        feed.put(rows[i : i + 41])
    feed.put(CLOSE)
    assert key(feed.run(gap, late)) == key(merge(spark.createDataFrame(rows, FORM), gap).collect())


def test_spans_leave_when_the_mark_has_passed_and_a_restart_goes_on(spark, tmp_path):
    rows, feed = sorted(made(3), key=lambda r: r[1]), Feed(spark, tmp_path)
    feed.put([*rows[:50], (1, 3.0, None), (1, None, 4.0)])
    feed.put(rows[50:70])
    want = key(merge(spark.createDataFrame(rows, FORM), 0.1).collect())
    first = key(feed.run(0.1, "1 second"))
    assert first and len(first) < len(want) and set(first) <= set(want)
    feed.put(rows[70:])
    feed.put(CLOSE)
    assert key(feed.run(0.1, "1 second")) == want


def test_tables_and_empty_streams(spark):
    rows = [*made(4), (1, 2.0, None), (1, None, 2.0)]
    assert key(merged_spans(spark.createDataFrame(rows, FORM), 0.1).collect()) == key(merge(spark.createDataFrame(rows[:-2], FORM), 0.1).collect())
    assert streamed(spark, spark.createDataFrame([], FORM), 1).count() == 0


@pytest.mark.parametrize("parts,files", [(5, 4), (5, 1), (1, 3)])
def test_quarters_of_more_or_fewer_files_than_a_batch_takes(spark, parts, files):
    rng = random.Random(5)
    regions = [(rng.randrange(40), t := rng.uniform(0, 700), t + rng.uniform(0, 10)) for _ in range(1500)]
    rows = spark.createDataFrame(regions, FORM)
    assert key(streamed(spark, rows.repartition(parts), files).collect()) == key(merge(rows, 0.0).collect())


def test_tracks_share_states(spark, tmp_path):
    rng, base = random.Random(6), str(tmp_path)
    rows = [(rng.choice([None, "", "a", f"t{rng.randrange(300)}"]), t := rng.uniform(0, 50), t + rng.uniform(0, 2)) for _ in range(2000)]
    frame = spark.createDataFrame([*rows, (None, 1e6, None)], FORM.replace("bigint", "string"))
    frame.coalesce(1).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{base}/in")
    q = merged_spans(stream, 0.1, "200 seconds", buckets=8).writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in q.recentProgress) <= 8
    plain = lambda found: sorted((r["track"] or str(r["track"]), r["start"], r["end"], r["n"]) for r in found)
    assert plain(spark.read.parquet(f"{base}/out").collect()) == plain(merge(spark.createDataFrame(rows, stream.schema), 0.1).collect())
