"""Queries through files and streams: waves written and read as files, spans merged on the way. Work files lie in the shared folder."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.waveforms import split_exactly
from ..session import shuffled_by, work_folder
from ..sources.waves import read_waves, write_segments, write_waves
from ..streaming.spans import merged_spans
from . import events as E
from .events import _r, _regions, points
from .signals import _WV, _waves

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = E.registrar(QUERIES, ORACLES)

VECTORS, RATE = 16, 64
#: Rows for which a stream gets one more state partition. A partition starts Python workers and commits its state in every micro-batch, however few its rows.
ROWS = 1_000_000
#: A sample as a file of so many bits gives it back.
_KEPT = "round_even(greatest(-1, least(1, x)) * {most}, 0) / {scale}::double"
_KEPT_24, _KEPT_16 = _KEPT.format(most=(1 << 23) - 1, scale=1 << 23), _KEPT.format(most=(1 << 15) - 1, scale=1 << 15)


@query(_WV + f""" select track // {VECTORS} as track, row_number() over (partition by track // {VECTORS} order by track) - 1 as second, count(*) over (partition by track // {VECTORS}) * {RATE} as length,
 round(list_sum(list_transform(s, lambda x: {_KEPT_24})), 7) as total, round(list_max(list_transform(s, lambda x: {_KEPT_24})), 7) as peak from wv""")
def wave_files(spark, sf_dir):
    """Vectors as seconds of waves, written to files of 24 bits and read back by the second."""
    whole = Window.partitionBy("wave")
    w = _waves(spark, sf_dir).withColumn("wave", F.expr(f"track div {VECTORS}"))
    w = w.select("wave", "samples", (F.row_number().over(whole.orderBy("track")) - 1).alias("chunk"), (F.sum(F.size("samples")).over(whole)).alias("length"))
    folder = work_folder(spark, "wave_files")
    write_waves(w.withColumn("path", F.format_string("wave-%d", "wave")), folder, RATE, bits=24)
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    back = read_waves(spark, folder, chunkFrames=RATE)
    return back.select(F.regexp_extract("path", r"-(\d+)", 1).cast("bigint").alias("track"), F.col("chunk").alias("second"), "length", F.round(total, 7).alias("total"), F.round(F.array_max("samples"), 7).alias("peak"))


@query(_WV + f""" select track, 'segment_00' || (n + 1) || case when voiced then '_human' else '_music' end || '_' || secs as name, b - a as length, round(list_sum(list_transform(s[a + 1:b], lambda x: {_KEPT_16})), 7) as total
 from (select track, s, n, a, b, secs, list_sum(list_transform(s[a + 1:b], lambda x: x)) > 0 as voiced from wv, (select unnest([0, 1, 2]) as n, unnest([0, 20, 41]) as a, unnest([20, 41, 64]) as b, unnest(['0.3', '0.3', '0.4']) as secs))""")
def segment_files(spark, sf_dir):
    """Waves cut into pieces, each a file of 16 bits named by its number, label and length."""
    w = _waves(spark, sf_dir)
    cuts = w.select("track", F.explode(F.array(*(F.lit(x) for x in (20, 41)))).alias("at"))
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    folder = work_folder(spark, "segment_files")
    write_segments(split_exactly(w, cuts, 8).withColumn("voiced", total > 0), folder, RATE, bits=16)
    back = read_waves(spark, folder)
    return back.select(F.regexp_extract("path", r"^(\d+)/", 1).cast("bigint").alias("track"), F.regexp_extract("path", r"/(.*)\.wav$", 1).alias("name"), "length", F.round(total, 7).alias("total"))


@query("""select track, round(start, 6) as start, round("end", 6) as "end", n from merged""")
def streamed_spans(spark, sf_dir):
    """Regions of events merged on a stream that gets them quarter by quarter of the time, then a row that closes all."""
    return streamed(spark, _regions(points(spark, sf_dir)), spark.sparkContext.defaultParallelism).select("track", _r("start"), _r("end"), "n")


def streamed(spark, regions, files: int):
    """regions (times in hours) merged by a stream that takes so many files at a time. A quarter may be more or fewer files than that, so that a micro-batch begins or ends within
    a quarter: no row comes later than a quarter."""
    folder, form = work_folder(spark, "streamed_spans"), "track bigint, start double, end double"
    regions.write.parquet(f"{folder}/regions")
    rows = spark.read.schema(form).parquet(f"{folder}/regions")
    first, last, end, n = rows.agg(F.min("start"), F.max("start"), F.max("end"), F.count("*")).first()
    for part in range(4 if last is not None else 0):
        lo, hi = (first + (last - first) * x / 4 for x in (part, part + 1))
        rows.where((F.col("start") >= lo) & ((F.col("start") < hi) | F.lit(part == 3))).write.mode("append").parquet(f"{folder}/in")
    late = 1.0 + (0.0 if last is None else (last - first) / 4)
    closing = spark.range(1).select(F.lit(None).cast("bigint").alias("track"), F.lit((end or 0.0) + late + 10.0).alias("start"), F.lit(None).cast("double").alias("end"))
    closing.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(form).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    merged = merged_spans(stream, late=f"{math.ceil(late * 3600)} seconds", second=3600.0)
    with shuffled_by(spark, max(files, n // ROWS)):
        q = merged.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
        q.awaitTermination()
    return spark.read.schema("track bigint, start double, end double, n bigint").parquet(f"{folder}/out")
