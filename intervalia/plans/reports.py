"""Queries over reports; cuts are a track's clicks, segments lie between its events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import reports as R
from . import events as E
from .boundaries import _MORE, _parts
from .events import _BASE, _r, points

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = E.registrar(QUERIES, ORACLES)

_X = _MORE + """sg as (select track, t as start, nx as "end", nx - t as duration_s, event_type = 'view' as voiced, value, idx from (select *, lead(t) over (partition by track order by idx) as nx from p) where nx is not null),
cu as (select track, event_id as cut, t, value / 500 as score, case event_id % 3 when 0 then ['beat'] when 1 then ['breath', 'lyrics'] else ['lyrics'] end as sources, (event_id % 10) / 9.0::double as beat_affinity, case when event_id % 4 = 0 then null else value % 40 - 20 end as guard_shift_ms from p where event_type = 'click')"""


def _segments(p):
    w = Window.partitionBy("track").orderBy("idx")
    x = p.withColumn("end", F.lead("t").over(w)).where("end is not null")
    return x.select("track", F.col("t").alias("start"), "end", (F.col("end") - F.col("t")).alias("duration_s"), (F.col("event_type") == "view").alias("voiced"), "value", "idx")


def _cuts(p):
    i = F.col("event_id")
    sources = F.when(i % 3 == 0, F.array(F.lit("beat"))).when(i % 3 == 1, F.array(F.lit("breath"), F.lit("lyrics"))).otherwise(F.array(F.lit("lyrics")))
    shift = F.when(i % 4 == 0, None).otherwise(F.col("value") % 40 - 20)
    return p.where("event_type = 'click'").select("track", i.alias("cut"), "t", (F.col("value") / 500).alias("score"), sources.alias("sources"), (i % 10 / 9.0).alias("beat_affinity"), shift.alias("guard_shift_ms"))


@query(_X + """, ic as (select c.* from cu c join tracks using (track) where t > 1e-9 and t < duration - 1e-9),
 s1 as (select track, count(*) as n, median(duration_s) as md, avg(case when duration_s between 5 and 15 then 1.0 else 0.0 end) as fit from sg group by track),
 c1 as (select track, avg(score) as sc, quantile_cont(abs(guard_shift_ms), 0.5) as p50, quantile_cont(abs(guard_shift_ms), 0.95) as p95 from cu group by track),
 c2 as (select track, count(*) as n, avg(case when list_contains(sources, 'breath') then 1.0 else 0.0 end) as br, avg(case when list_contains(sources, 'beat') or beat_affinity >= 0.8 then 1.0 else 0.0 end) as bt,
   avg(case when exists(select 1 from cw w where w.track = ic.track and w.start < ic.t and ic.t < w."end") then 1.0 else 0.0 end) as iw, avg(case when exists(select 1 from cr w where w.track = ic.track and w.start < ic.t and ic.t < w."end") then 1.0 else 0.0 end) as ir from ic group by track),
 w1 as (select track, avg(confidence) as cf from cw group by track),
 wc as (select w.track, greatest(0, start) as start, least("end", duration) as "end" from cw w join tracks using (track) where least("end", duration) > greatest(0, start)),
 wm as (select *, max("end") over (partition by track order by start, "end" rows between unbounded preceding and 1 preceding) as m from wc),
 wg as (select *, sum(case when m is null or start > m then 1 else 0 end) over (partition by track order by start, "end" rows unbounded preceding) as g from wm),
 cv as (select track, sum(e - s) as c from (select track, min(start) as s, max("end") as e from wg group by track, g) group by track)
 select track, coalesce(s1.n, 0) as segments_count, round(md, 6) as median_segment_s, round(coalesce(fit, 0), 6) as segment_5_15_pass_rate, round(coalesce(iw, 0), 6) as cut_inside_word_rate, round(coalesce(ir, 0), 6) as cut_inside_singing_rate, round(sc, 8) as avg_boundary_score,
  round(coalesce(c, 0) / duration, 6) as lyrics_coverage_ratio, round(cf, 8) as asr_avg_confidence, round(p50, 6) as guard_shift_p50_ms, round(p95, 6) as guard_shift_p95_ms, round(coalesce(br, 0), 6) as breath_cut_ratio, round(coalesce(bt, 0), 6) as beat_aligned_ratio,
  case when track % 5 = 0 then 'no_lyrics' end as fallback_reason from tracks left join s1 using (track) left join c1 using (track) left join c2 using (track) left join w1 using (track) left join cv using (track)""")
def track_qa_report(spark, sf_dir):
    p = points(spark, sf_dir)
    words, regions, _ = _parts(p)
    tracks = E._tracks(p).withColumn("fallback_reason", F.when(F.col("track") % 5 == 0, "no_lyrics"))
    x = R.qa_report(tracks, _segments(p), _cuts(p), words, regions)
    eight = ("avg_boundary_score", "asr_avg_confidence")
    return x.select(*(c if c in ("track", "segments_count", "fallback_reason") else _r(c, 8 if c in eight else 6) for c in x.columns))


@query(_X + " select track, round(coalesce(avg(abs(g)), 0), 8) as mean, round(coalesce(quantile_cont(abs(g), 0.5), 0), 6) as p50, round(coalesce(quantile_cont(abs(g), 0.95), 0), 6) as p95, round(coalesce(max(abs(g)), 0), 6) as largest from tracks left join (select track, guard_shift_ms as g from cu where guard_shift_ms > 5) using (track) group by track")
def cut_error_summary(spark, sf_dir):
    p = points(spark, sf_dir)
    errors = _cuts(p).where("guard_shift_ms > 5").select("track", F.col("guard_shift_ms").alias("ms"))
    return R.cut_errors(E._tracks(p), errors).select("track", _r("mean", 8), _r("p50"), _r("p95"), _r("largest"))


def _acceptance(p):
    words, regions, _ = _parts(p)
    cuts, refs = _cuts(p).select("track", "t"), p.where("event_type = 'signup' and track % 2 = 0").select("track", F.col("t").alias("r"))
    matched = C.match_one_to_one(cuts, refs, 2.0)
    return R.acceptance(cuts, words, regions.where("confidence >= 0.8"), _segments(p), matched, refs)


_ACCEPT = _BASE.replace("with e as", "with recursive e as", 1) + _X + """, ref as (select track, list(t order by t) as refs from p where event_type = 'signup' and track % 2 = 0 group by track),
 pd as (select track, t, row_number() over (partition by track order by t) as n from cu),
 mt as (select track, 0::bigint as n, []::bigint[] as used, null::bigint as hit from ref
  union all select x.track, y.n, case when y.b is null then used else used || [y.b] end, y.b from (select mt.track, mt.n + 1 as m, used, refs from mt join ref using (track)) x
   join lateral (select pd.n, list_reduce([struct_pack(d := 2.0::double, i := null::bigint)] || [struct_pack(d := abs(x.refs[i] - pd.t), i := i) for i in range(1, len(x.refs) + 1) if abs(x.refs[i] - pd.t) <= 2.0 and not list_contains(x.used, i)], lambda a, z: case when z.d <= a.d then z else a end).i as b from pd where pd.track = x.track and pd.n = x.m) y on true),
 fig as (select 2 * (select count(*) from mt where hit is not null)::double / ((select count(*) from cu where track in (select track from ref)) + (select sum(len(refs)) from ref)) as boundary_f1,
  (select avg(case when exists(select 1 from cw w where w.track = c.track and w.start < c.t and c.t < w."end") then 1.0 else 0.0 end) from cu c) as cut_inside_word_rate,
  (select avg(case when exists(select 1 from cr w where w.track = c.track and confidence >= 0.8 and w.start < c.t and c.t < w."end") then 1.0 else 0.0 end) from cu c) as cut_inside_sure_singing_rate,
  (select avg(case when duration_s between 5 and 15 then 1.0 else 0.0 end) from sg) as segment_5_15_pass_rate, (select count(*) from cu) as cuts, (select count(*) from cw) as words, (select count(*) from sg) as segments)"""
_RATES = ["boundary_f1", "cut_inside_word_rate", "cut_inside_sure_singing_rate", "segment_5_15_pass_rate"]


@query()
def acceptance_figures(spark, sf_dir):
    return _acceptance(points(spark, sf_dir)).select(*(_r(c) for c in _RATES), "cuts", "words", "segments")


ORACLES["acceptance_figures"] = _ACCEPT + " select " + ", ".join(f"round({c}, 6) as {c}" for c in _RATES) + ", cuts, words, segments from fig"
#: Fixed values.
_GATES = {"boundary_f1": 0.82, "cut_inside_word_rate": 0.01, "cut_inside_sure_singing_rate": 0.03, "segment_5_15_pass_rate": 0.90}


@query()
def acceptance_gate_report(spark, sf_dir):
    return R.gates(_acceptance(points(spark, sf_dir)), _GATES, ("cut_inside_word_rate", "cut_inside_sure_singing_rate")).select("gate", _r("value"), "threshold", "status")


ORACLES["acceptance_gate_report"] = _ACCEPT + " " + " union all ".join(f"select '{g}' as gate, round({g}, 6) as value, {t}::double as threshold, case when {g} is null then 'insufficient_data' when {g} {'<=' if 'inside' in g else '>='} {t} then 'pass' else 'fail' end as status from fig" for g, t in _GATES.items())


@query(_X + " select track, round(case when sum(w) > 0 then sum(v * w) / sum(w) else avg(v) end, 8) as average from (select track, value as v, case when track % 3 = 0 then 0 else duration_s end as w from sg) group by track")
def weighted_average(spark, sf_dir):
    w = F.when(F.col("track") % 3 == 0, 0.0).otherwise(F.col("duration_s"))
    return _segments(points(spark, sf_dir)).groupBy("track").agg(F.round(R.weighted_average(F.col("value"), w), 8).alias("average"))


_METRICS = _X + """, mb as (select event_type as metric, avg(value) as value, case when event_type < 'm' then 'min' else 'max' end as kind from p where idx <= 40 group by event_type),
 ml as (select *, case when kind = 'min' then case when value > 0 then value * 0.98 else 0 end else case when value > 0 then greatest(0.02, value * 1.02) else 0.02 end end as lim from mb)"""


def _metrics(p, late: bool):
    kind = F.when(F.col("event_type") < "m", "min").otherwise("max")
    return p.where("idx > 40" if late else "idx <= 40").groupBy(F.col("event_type").alias("metric"), kind.alias("kind")).agg(F.avg("value").alias("value"))


@query(_METRICS + ' select metric, kind, round(lim, 9) as "limit" from ml')
def guardrail_limits(spark, sf_dir):
    return R.guardrails(_metrics(points(spark, sf_dir), False), 0.02).select("metric", "kind", _r("limit", 9))


@query(_METRICS + ', mn as (select event_type as metric, avg(value) as now from p where idx > 40 group by event_type) select metric, round(now, 9) as value, round(lim, 9) as "limit", round(now - value, 9) as change from ml join mn using (metric) where case when kind = \'min\' then now < lim else now > lim end')
def guardrail_violations(spark, sf_dir):
    p = points(spark, sf_dir)
    return R.violations(R.guardrails(_metrics(p, False), 0.02), _metrics(p, True)).select("metric", _r("value", 9), _r("limit", 9), _r("change", 9))


@query(_X + " select track, count(*) as segments, count(*) filter (duration_s <= 0) as empty, count(*) filter (duration_s < 5) as below, count(*) filter (duration_s > 15) as above, round(median(duration_s), 6) as median_s, round(avg(duration_s), 6) as mean_s, round(min(duration_s), 6) as shortest_s, round(max(duration_s), 6) as longest_s from sg group by track")
def regression_summary(spark, sf_dir):
    return R.regression_summary(_segments(points(spark, sf_dir)), 5.0, 15.0).select("track", "segments", "empty", "below", "above", _r("median_s"), _r("mean_s"), _r("shortest_s"), _r("longest_s"))


@query(""" select coalesce(a.event_id, b.event_id) as event_id, case when b.event_id is null then 'missing' when a.event_id is null then 'extra' else 'changed' end as state from (select event_id, event_type, value from p where event_id % 7 != 0) a
 full join (select event_id, event_type, case when event_id % 11 = 0 then value + 1 else value end as value from p where event_id % 5 != 0) b on a.event_id = b.event_id where a.event_id is null or b.event_id is null or a.value != b.value""")
def manifest_difference(spark, sf_dir):
    p = points(spark, sf_dir).select("event_id", "event_type", "value")
    after = p.where("event_id % 5 != 0").withColumn("value", F.when(F.col("event_id") % 11 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return R.manifest_diff(p.where("event_id % 7 != 0"), after, ["event_id"], ["event_type", "value"])


@query(_X + """, fe as (select track, count(*) filter (event_type = 'click') / max(t) * 2500 as bpm, avg(value) / max(value) as mdd, stddev_pop(value) / avg(value) as energy_cv, avg(case when event_type = 'view' then 1.0 else 0.0 end) * 2 as voice_coverage from p group by track)
 select track, round(bpm, 6) as bpm, case when bpm <= 0 then 'pop' when bpm <= 88 and energy_cv <= 0.25 then 'ballad' when bpm >= 122 and energy_cv >= 0.65 and voice_coverage <= 0.55 then 'edm' when bpm >= 118 and mdd >= 0.45 and voice_coverage >= 0.68 then 'rap' else 'pop' end as profile,
  case when bpm <= 0 then 0.25 when bpm <= 88 and energy_cv <= 0.25 then 0.78 when (bpm >= 122 and energy_cv >= 0.65 and voice_coverage <= 0.55) or (bpm >= 118 and mdd >= 0.45 and voice_coverage >= 0.68) then 0.82 else 0.7 end::double as confidence from fe""")
def style_profile(spark, sf_dir):
    v = F.col("value")
    clicks = F.count(F.when(F.col("event_type") == "click", 1))
    f = points(spark, sf_dir).groupBy("track").agg((clicks / F.max("t") * 2500).alias("bpm"), (F.avg(v) / F.max(v)).alias("mdd"), (F.stddev_pop(v) / F.avg(v)).alias("energy_cv"), (F.avg(F.when(F.col("event_type") == "view", 1.0).otherwise(0.0)) * 2).alias("voice_coverage"))
    return R.style(f).select("track", _r("bpm"), "profile", "confidence")


@query(_X + """, en as (select track, avg(value * value) filter (event_type = 'view') as voice, avg(value * value) filter (event_type = 'click') as rest, avg(value * value) as mix from p group by track)
 select track, round(coalesce(0.5 * least(1, voice / (mix + 1e-8)) + 0.5 * least(1, voice / (rest + 1e-8) / (1 + voice / (rest + 1e-8))), least(1, voice / (mix + 1e-8))), 6) as confidence from en where voice is not null""")
def separation_confidence(spark, sf_dir):
    square = F.col("value") * F.col("value")
    of = lambda k: F.avg(F.when(F.col("event_type") == k, square))
    e = points(spark, sf_dir).groupBy("track").agg(of("view").alias("voice"), of("click").alias("rest"), F.avg(square).alias("mix")).where("voice is not null")
    return R.separation_confidence(e).select("track", _r("confidence"))


_QUALITY = _X + """, mq as (select track, idx, duration_s, value / 50 as beats, ['slow', 'medium', 'fast', 'rapid'][idx % 4 + 1] as category, value / 500 as complexity, 1 + (value % 100) / 100 as comp, case when idx % 5 = 0 then null else (value % 10) / 10 end as audio from sg),
 mi as (select *, case category when 'slow' then 8 when 'medium' then 6 when 'fast' then 4 else 3 end as lo, case category when 'slow' then 20 when 'medium' then 15 when 'fast' then 12 else 8 end as hi from mq),
 qq as (select track, idx, duration_s, (0.3 * least(1, greatest(0, 1 - abs(beats - round_even(beats, 0)) / 0.5)) + 0.25 * case when duration_s between 4 and 16 then 1 when duration_s < 4 then least(1, greatest(0.2, duration_s / 4)) else least(1, greatest(0.2, 16 / duration_s)) end
  + 0.2 * case when duration_s between lo and hi then 1 when duration_s < lo then greatest(0.3, duration_s / lo) else greatest(0.3, hi / duration_s) end + 0.15 * greatest(0.2, 1 - abs(comp - (1 + complexity * 0.5)) / (1 + complexity * 0.5)) + coalesce(0.1 * audio, 0)) / case when audio is null then 0.9 else 1.0 end as quality from mi)"""


def _rated(p):
    category = F.element_at(F.array(F.lit("slow"), F.lit("medium"), F.lit("fast"), F.lit("rapid")), (F.col("idx") % 4 + 1).cast("int"))
    s = _segments(p).select("track", "idx", "duration_s", (F.col("value") / 50).alias("beats"), F.lit(4.0).alias("low"), F.lit(16.0).alias("high"), category.alias("category"), (F.col("value") / 500).alias("complexity"), (1 + F.col("value") % 100 / 100).alias("compensation"), F.when(F.col("idx") % 5 == 0, None).otherwise(F.col("value") % 10 / 10).alias("audio"))
    return R.musical_quality(s)


@query(_QUALITY + " select track, idx, round(quality, 6) as quality from qq")
def musical_quality(spark, sf_dir):
    return _rated(points(spark, sf_dir)).select("track", "idx", _r("quality"))


@query(_QUALITY + """, ag as (select track, avg(quality) as overall, count(*) as segments, avg(duration_s) as mean_s, stddev_pop(duration_s) as std_s, min(quality) as worst, max(quality) as best, count(*) filter (quality >= 0.8) as excellent, count(*) filter (quality >= 0.6 and quality < 0.8) as good, count(*) filter (quality >= 0.4 and quality < 0.6) as fair, count(*) filter (quality < 0.4) as poor from qq group by track)
 select track, round(overall, 6) as overall, segments, round(mean_s, 6) as mean_s, round(std_s, 6) as std_s, round(worst, 6) as worst, round(best, 6) as best, excellent, good, fair, poor,
  coalesce(nullif(concat_ws(',', case when mean_s < 7 then 'short' end, case when mean_s > 13 then 'long' end, case when overall < 0.6 then 'weak' end, case when segments < 3 then 'few' end, case when segments > 20 then 'many' end), ''), 'none') as issues from ag""")
def segment_quality_report(spark, sf_dir):
    return R.quality_report(_rated(points(spark, sf_dir))).select("track", *(_r(c) for c in ("overall", "mean_s", "std_s", "worst", "best")), "segments", "excellent", "good", "fair", "poor", "issues")


@query(""", ad as (select track, value - 200 as g, value % 50 - 25 as v, value % 30 - 20 as m from p)
 select track, round(avg(abs(g)), 8) as mean_ms, round(max(abs(g)), 6) as largest_ms, round(quantile_cont(abs(g), 0.95), 6) as p95_ms, round(coalesce(avg(v) filter (v > 0), 0), 9) as voice_ms, round(coalesce(avg(m) filter (m > 0), 0), 9) as mix_ms, count(*) as n, avg(abs(g)) <= 130 and quantile_cont(abs(g), 0.95) <= 270 as passes from ad group by track""")
def guard_shift_gate(spark, sf_dir):
    v = F.col("value")
    ad = points(spark, sf_dir).select("track", (v - 200).alias("guard_ms"), (v % 50 - 25).alias("voice_ms"), (v % 30 - 20).alias("mix_ms"))
    return R.shift_gate(ad, 130.0, 270.0).select("track", _r("mean_ms", 8), _r("largest_ms"), _r("p95_ms"), _r("voice_ms", 9), _r("mix_ms", 9), "n", "passes")


@query(_X + """, sn as (select track, string_agg(printf('segment_%03d_%s_%.1f', n, case when voiced then 'human' else 'music' end, duration_s), ',' order by n) as names, count(*) as segments from (select *, row_number() over (partition by track order by start, "end") as n from sg) group by track)
 select track, round(duration, 6) as duration, coalesce(names, '') as names, coalesce(segments, 0) as segments, (select count(*) from cu where cu.track = tracks.track) as cuts from tracks left join sn using (track)""")
def track_manifest(spark, sf_dir):
    p = points(spark, sf_dir)
    cuts = _cuts(p).select("track", "t", "score", F.element_at("sources", 1).alias("source"))
    m = R.manifest(E._tracks(p), _segments(p), cuts)
    return m.select("track", _r("duration"), F.array_join(F.transform("segments", lambda s: s["name"]), ",").alias("names"), F.size("segments").cast("bigint").alias("segments"), F.size("cuts").cast("bigint").alias("cuts"))
