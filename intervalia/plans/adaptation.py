"""Queries over adaptive thresholds, cut lists, timelines and what leaves the library."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import adaptation as A
from ..sources import files, timelines
from . import events as E
from .events import _BASE, _r, points

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = E.registrar(QUERIES, ORACLES)

_TEMPO = ", tp as (select track, case when track % 7 = 0 then null else count(*) / max(t) * 1100 end as bpm, case when track % 5 = 0 then null else avg(value) / max(value) end as mdd from p group by track)"


def _tempo(p):
    rate, blend = F.count("*") / F.max("t") * 1100, F.avg("value") / F.max("value")
    return p.groupBy("track").agg(rate.alias("bpm"), blend.alias("mdd")).select("track", F.when(F.col("track") % 7 != 0, F.col("bpm")).alias("bpm"), F.when(F.col("track") % 5 != 0, F.col("mdd")).alias("mdd"))


@query(_TEMPO + """, pk as (select track, bpm, least(0.6, greatest(0.05, 0.3 * case when bpm > 140 then 0.92 when bpm > 0 and bpm < 90 then 1.08 else 1.0 end::double * case when mdd is null then 1.0 else least(1.15, greatest(0.85, 1 + 0.2 * mdd)) end)) as peak from tp)
 select track, round(peak::double, 6) as peak_ratio, round(greatest(peak + 0.02, 0.36)::double, 6) as rms_ratio, round(case when bpm > 0 then greatest(0.3, 0.5 - 0.18 * least(1, greatest(-1, (bpm - 110) / 110))) else 0.5 end::double, 6) as least_pause from pk""")
def adaptive_thresholds(spark, sf_dir):
    x = A.thresholds(_tempo(points(spark, sf_dir)), 0.3)
    return x.select("track", _r("peak_ratio"), _r("rms_ratio"), F.round(A.least_pause(F.col("bpm"), 0.5, 1.0), 6).alias("least_pause"))


@query(_TEMPO + """, w as (select track, unnest(['ballad', 'pop', 'rap', 'edm']) as profile, unnest([least(1, greatest(0, (110 - bpm) / 50)), least(1, greatest(0, least((bpm - 60) / 50, (140 - bpm) / 30))), least(1, greatest(0, least((bpm - 110) / 30, (160 - bpm) / 20))), least(1, greatest(0, (bpm - 140) / 20))]) as weight from tp where bpm is not null)
 select track, profile, round(weight, 6) as weight from w where weight > 0""")
def profile_weights(spark, sf_dir):
    return A.profile_weights(_tempo(points(spark, sf_dir)).where("bpm is not null")).select("track", "profile", _r("weight"))


_REC = _BASE.replace("with e as", "with recursive e as", 1)


@query()
def split_gap_validation(spark, sf_dir):
    p = points(spark, sf_dir).where("event_type = 'view'").select("track", "t", F.lit(1.5).alias("beat"))
    return A.validated_gaps(p, 6.0).select("track", F.col("ord").cast("bigint").alias("ord"), _r("t"), "moved")


ORACLES["split_gap_validation"] = _REC + """, vp as (select track, t, row_number() over (partition by track order by t) as n from p where event_type = 'view'),
 vg as (select track, n, t as last, true as took, false as moved from vp where n = 1
  union all select v.track, v.n, case when v.t - last >= 6 then v.t when round_even((last + 6) / 1.5, 0) * 1.5 < v.t + 1.5 then round_even((last + 6) / 1.5, 0) * 1.5 else last end,
   v.t - last >= 6 or round_even((last + 6) / 1.5, 0) * 1.5 < v.t + 1.5, v.t - last < 6 from vg join vp v on v.track = vg.track and v.n = vg.n + 1)
 select track, row_number() over (partition by track order by n) - 1 as ord, round(last, 6) as t, moved from vg where took"""


@query()
def least_length_merge(spark, sf_dir):
    return A.least_lengths(points(spark, sf_dir).select("track", "t"), 10.0).select("track", F.col("ord").cast("bigint").alias("ord"), _r("t"))


ORACLES["least_length_merge"] = _REC + """, g as (select track, min(t) as t from p group by track union all select g.track, (select min(p.t) from p where p.track = g.track and p.t - g.t >= 10.0) from g where g.t is not null),
 k as (select track, t, row_number() over (partition by track order by t desc) as back, row_number() over (partition by track order by t) - 1 as ord from g where t is not null)
 select track, ord, round(case when back = 1 then duration else t end, 6) as t from k join tracks using (track)"""


_SEGS = """, sg as (select track, idx as seg, t as start, nx as "end", event_type = 'purchase' as lib, lead(idx, 2) over (partition by track order by idx) is null as final from (select *, lead(t) over (partition by track order by idx) as nx from p)),
 sh as (select *, "end" - start < 5 and not lib and not final as short from sg where "end" is not null), gr as (select *, coalesce(sum(case when short then 0 else 1 end) over (partition by track order by seg rows between unbounded preceding and 1 preceding), 0) as g from sh)"""


@query(_SEGS + ' select track, round(min(start), 6) as start, round(max("end"), 6) as "end", bool_or(lib) and count(*) = 1 as lib from gr group by track, g')
def short_segment_drop(spark, sf_dir):
    w = Window.partitionBy("track").orderBy("idx")
    x = points(spark, sf_dir).withColumn("end", F.lead("t").over(w)).where("end is not null")
    s = x.select("track", F.col("idx").alias("seg"), F.col("t").alias("start"), "end", (F.col("event_type") == "purchase").alias("lib"))
    return A.drop_short(s, 5.0).select("track", _r("start"), _r("end"), "lib")


_ITEMS = """, it as (select track, event_id, t - 2 as start, t - 2 + value / 100 as "end", value / 450 as confidence, case when event_id % 9 = 0 then ' ' else event_type end as text, duration from p join tracks using (track))"""


def _items(p):
    return p.join(E._tracks(p), "track").select("track", "event_id", (F.col("t") - 2).alias("start"), (F.col("t") - 2 + F.col("value") / 100).alias("end"), (F.col("value") / 450).alias("confidence"), F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.col("event_type")).alias("text"), "duration")


@query(_ITEMS + """ select event_id, concat_ws(',', case when start < 0 then 'start' end, case when "end" <= start + 1e-9 then 'order' end, case when "end" > duration + 1e-9 then 'duration' end, case when confidence > 1 then 'confidence' end, case when trim(text) = '' then 'text' end) as reason from it
 where start < 0 or "end" <= start + 1e-9 or "end" > duration + 1e-9 or confidence > 1 or trim(text) = ''""")
def invalid_items(spark, sf_dir):
    return timelines.invalid(_items(points(spark, sf_dir))).select("event_id", "reason")


@query(_ITEMS + """, oc as (select *, "end" > duration + 1e-9 and "end" <= duration + 1.5 and start < duration as clamped from it) select event_id, round(case when clamped then duration else "end" end, 6) as "end", clamped from oc""")
def overshoot_clamp(spark, sf_dir):
    return timelines.clamped(_items(points(spark, sf_dir)), 1.5).select("event_id", _r("end"), "clamped")


@query(""" select doc_id, 'lyrics:' || sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || n_chars || ',"source":' || coalesce('"' || source || '"', 'null') || '}') as key, sha256(coalesce(text, '')) as checksum from documents""")
def cache_keys(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", files.cache_key("source", "doc_id", "lang", "n_chars").alias("key"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("checksum"))


@query(""" select page_id, case when starts_with(url, 'https:/') then substr(url, 8) else url end as path from pages""")
def relative_paths(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", files.relative(F.col("url"), "https:/").alias("path"))


@query(""" select doc_id::varchar as track, '' as title, coalesce(lang, '') as category, coalesce(source, '') as path, case when quality = 1 then 'ok' else '' end as status, '' as segments, '' as cuts, '' as words, '' as cut_inside_word_rate, '' as segment_5_15_pass_rate, toxic::varchar as naturalness, '' as note from documents join labels using (doc_id)""")
def review_table(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return files.review(d.select(F.col("doc_id").alias("track"), F.col("lang").alias("category"), F.col("source").alias("path"), F.when(F.col("quality") == 1, "ok").alias("status"), F.col("toxic").alias("naturalness")))
