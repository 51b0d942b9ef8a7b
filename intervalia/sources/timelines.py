"""Timeline documents: JSON scan with strict or lenient validation, key aliases and unit precedence, and a JSON sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ITEM = "STRUCT<text:STRING,word:STRING,token:STRING,start_ms:DOUBLE,start_s:DOUBLE,start:DOUBLE,end_ms:DOUBLE,end_s:DOUBLE,end:DOUBLE,confidence:DOUBLE>"
SCHEMA = f"track BIGINT, duration_s DOUBLE, source STRING, words ARRAY<{_ITEM}>, sentences ARRAY<{_ITEM}>, segments ARRAY<{_ITEM}>"


def read_timelines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def items(timelines: DataFrame, *fields: str, offset: float = 0.0) -> DataFrame:
    """track, text, start, end, confidence of the first of the fields that is there; milliseconds before _s before bare."""
    x = timelines.select("track", F.explode(F.coalesce(*(F.col(f) for f in fields))).alias("i"))
    time = lambda n: F.coalesce(F.col(f"i.{n}_ms") / 1000, F.col(f"i.{n}_s"), F.col(f"i.{n}")) + offset
    return x.select("track", F.coalesce("i.text", "i.word", "i.token").alias("text"), time("start").alias("start"), time("end").alias("end"), "i.confidence")


def nothing(spark: SparkSession, reason: str = "", strict: bool = False) -> DataFrame:
    """The empty timeline, or an error with the reason."""
    if strict:
        raise ValueError(reason or "no timeline source")
    return spark.createDataFrame([], SCHEMA)


def first_available(spark: SparkSession, readers: list) -> tuple[DataFrame, str]:
    """What the first reader gives that doesn't fail; else the empty timeline, with all reasons."""
    reasons = []
    for read in readers:
        try:
            found = read(spark)
            found.limit(1).count()
        except Exception as e:  # noqa: BLE001  any failure of a source passes on to the next
            reasons.append(str(e).splitlines()[0])
        else:
            return found, "; ".join(reasons)
    return nothing(spark), "; ".join(reasons)


def clamped(rows: DataFrame, slack: float = 1e-3) -> DataFrame:
    """rows (start, end, duration) with an end of up to slack behind the duration moved to it; clamped tells where."""
    over = (F.col("end") > F.col("duration") + 1e-9) & (F.col("end") <= F.col("duration") + slack) & (F.col("start") < F.col("duration"))
    over = F.coalesce(over, F.lit(False))
    return rows.withColumn("clamped", over).withColumn("end", F.when(F.col("clamped"), F.col("duration")).otherwise(F.col("end")))


def invalid(rows: DataFrame) -> DataFrame:
    """Rows that break a constraint, with reason: times in order and, with a column duration, inside it, confidence in [0, 1] or null, a text."""
    late = F.col("end") > F.col("duration") + 1e-9 if "duration" in rows.columns else F.lit(False)
    reason = F.array_compact(
        F.array(
            F.when(F.col("start") < 0, "start"),
            F.when(F.col("end") <= F.col("start") + 1e-9, "order"),
            F.when(late, "duration"),
            F.when(~F.col("confidence").between(0, 1), "confidence"),
            F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "text"),
        )
    )
    return rows.withColumn("reason", F.array_join(reason, ",")).where("reason != ''")


def write_timelines(words: DataFrame, path: str) -> None:
    doc = words.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text", "confidence"))).alias("words"))
    doc.write.json(path)
