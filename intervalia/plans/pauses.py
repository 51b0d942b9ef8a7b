"""Queries over pauses and voice spans; an event's value is its frame's level."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pauses as P
from . import events as E
from .events import _BASE, _r, points

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = E.registrar(QUERIES, ORACLES)


def _runs(name: str, src: str, flag: str, end: str = "max(t)") -> str:
    """CTEs of the runs of flag in src: start, end (the next frame's t, else ``end``), first, last and open."""
    return f"""{name}_f as (select *, ({flag}) as flag, lead(t) over (partition by track order by idx) as nt from {src}),
{name}_g as (select *, sum(case when flag is not distinct from pf then 0 else 1 end) over (partition by track order by idx rows unbounded preceding) as run from (select *, lag(flag) over (partition by track order by idx) as pf from {name}_f)),
{name} as (select track, min(t) as start, case when bool_or(nt is null) then {end} else max(nt) end as "end", min(idx) as first, max(idx) as last, bool_or(nt is null) as open from {name}_g where flag group by track, run)"""


def _shape(name: str, src: str, flag: str, fill: int, drop: int) -> str:
    """CTEs that close and open flag; ``on`` is the result."""
    step = lambda n, s, f: f"{n} as (select *, sum(case when {f} is not distinct from pf then 0 else 1 end) over (partition by track order by idx rows unbounded preceding) as r{n} from (select * exclude (pf), lag({f}) over (partition by track order by idx) as pf from {s}))"
    return f"""{name}_0 as (select *, ({flag}) as raw, null as pf from {src}), {step(name + "_1", name + "_0", "raw")},
{name}_2 as (select *, raw or count(*) over (partition by track, r{name}_1) <= {fill} as filled from {name}_1), {step(name + "_3", name + "_2", "filled")},
{name} as (select *, filled and count(*) over (partition by track, r{name}_3) > {drop} as "on" from {name}_3)"""


_FR = """, fr as (select track, idx, t, value, (event_id % 7) / 7.0::double as flatness, case when event_type = 'signup' then 1 else 0 end as onset, value % 13 + 1 as f0, value % 29 + 1 as centroid from p),
fw as (select track, start - 6 as start, "end" + 6 as "end" from regions),
"""


def _frames(p):
    return p.select("track", "idx", "t", "value", (F.col("event_id") % 7 / 7.0).alias("flatness"), F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("onset"), (F.col("value") % 13 + 1).alias("f0"), (F.col("value") % 29 + 1).alias("centroid"), F.col("value").alias("rms"))


_VALLEYS = _FR + """th as (select *, least(max(value) over w * 0.4, avg(value) over w * 0.9) as thr from fr window w as (partition by track)),
ins as (select distinct h.track, h.idx from th h join fw on h.track = fw.track and h.t between fw.start and fw."end"),
fo as (select h.*, i.idx is not null as inside, bool_or(i.idx is not null) over (partition by h.track) as found from th h left join ins i using (track, idx)),
""" + _runs("vr", "fo", "value < thr and (inside or not found)") + """,
vp as (select v.track, v.start, v."end", v.first, v.last, case when open then 0.8 else least(0.99, greatest(0.1, 0.6 * least(1, greatest(0, (v."end" - v.start - 2) / 22)) + 0.4 * least(1, greatest(0, 1 - avg(value) / any_value(thr))) + 0.1 * least(1, greatest(0, 1 - avg(flatness))))) end as confidence,
  avg(value) as energy, any_value(thr) as thr from vr v join th h on h.track = v.track and h.idx between v.first and v.last where v."end" - v.start >= 2 group by v.track, v.start, v."end", v.first, v.last, open)"""


def _valleys(p):
    focus = E._regions(p).select("track", (F.col("start") - 6).alias("start"), (F.col("end") + 6).alias("end"))
    return P.valley_pauses(_frames(p), 0.4, 0.9, 2.0, 24.0, focus)


@query(_VALLEYS + ' select track, round(start, 6) as start, round("end", 6) as "end", round(confidence, 6) as confidence, round(energy, 8) as energy, round(thr, 6) as threshold from vp')
def valley_pauses(spark, sf_dir):
    return _valleys(points(spark, sf_dir)).select("track", _r("start"), _r("end"), _r("confidence"), _r("energy", 8), _r("threshold"))


@query(_VALLEYS + ' select track, round(start, 6) as start, round("end", 6) as "end" from (select v.*, duration, row_number() over (partition by track order by thr - energy desc, confidence desc, start) as rn from vp v join tracks using (track)) where rn <= greatest(1, floor(duration / 96))')
def valley_cap(spark, sf_dir):
    p = points(spark, sf_dir)
    return P.cap_valleys(_valleys(p), E._tracks(p), 96.0).select("track", _r("start"), _r("end"))


_VOICE = _FR + "dbs as (select *, 20 * log10(value + 1e-12) as db from fr), dq as (select *, quantile_cont(db, 0.1) over w as q10, quantile_cont(db, 0.9) over w as q90, quantile_cont(db, 0.05) over w as q05 from dbs window w as (partition by track)),\n"


@query(_VOICE + _shape("sh", "dq", "db > greatest(q10 + 3, 0.5 * (q10 + q90))", 1, 1) + ", tf as (select s.* exclude (pf, raw), duration from sh s join tracks using (track)),\n" + _runs("nv", "tf", 'not "on"', "max(duration)") + ' select track, round(start, 6) as start, round("end", 6) as "end" from nv where "end" - start >= 6')
def no_voice_runs(spark, sf_dir):
    p = points(spark, sf_dir)
    return P.no_voice(_frames(p), E._tracks(p), 3.0, 1, 1, 6.0).select("track", _r("start"), _r("end"))


@query(_VOICE + _shape("sh", "dq", "db > q05 + 12", 2, 1) + """,
bl as (select *, count(*) over (partition by track, blk) as size from (select *, sum(case when "on" is not distinct from po then 0 else 1 end) over (partition by track order by idx rows unbounded preceding) as blk from (select *, lag("on") over (partition by track order by idx) as po from sh)) where "on"),
bk as (select * from bl where size >= 4),
rr as (select *, sum(case when raw is not distinct from pr then 0 else 1 end) over (partition by track, blk order by idx rows unbounded preceding) as rrun from (select *, lag(raw) over (partition by track, blk order by idx) as pr from bk)),
rest as (select track, count(*) as n from rr where not raw group by track, blk, rrun having count(*) < 3),
tot as (select track, count(*) * 0.5::double as sung from bk group by track),
prof as (select track, quantile_cont(n * 0.5::double, 0.5) as md, quantile_cont(n * 0.5::double, 0.95) as p95, count(*) / (any_value(sung) / 60) as rate, sum(n) * 0.5::double / any_value(sung) as share from rest join tot using (track) group by track)
 select track, round(md, 6) as median, round(p95, 6) as p95, round(rate, 6) as rate, round(share, 6) as share, case when md >= 0.6 or p95 >= 1.2 or share >= 0.35 then 'slow' when md <= 0.25 and rate >= 18 and share <= 0.15 then 'fast' else 'medium' end as "class",
  case when md >= 0.6 or p95 >= 1.2 or share >= 0.35 then 1.08 when md <= 0.25 and rate >= 18 and share <= 0.15 then 0.92 else 1.0 end::double as multiplier from prof""")
def pause_profile(spark, sf_dir):
    return P.pause_profile(_frames(points(spark, sf_dir)), 0.5, 12.0, 2, 1, 4, 3).select("track", _r("median"), _r("p95"), _r("rate"), _r("share"), "class", "multiplier")


_PRESENCE = _FR + """pg as (select track, idx, t, value > 250 as flag, sum(case when (value > 250) is not distinct from pf then 0 else 1 end) over (partition by track order by idx rows unbounded preceding) as run from (select *, lag(value > 250) over (partition by track order by idx) as pf from fr)),
ps as (select track, row_number() over w - 1 as seg, case when row_number() over w = 1 then 0 else s end as start, coalesce(lead(s) over w, duration) as "end", flag as voiced, duration from (select track, run, flag, min(t) as s from pg group by track, run, flag) join tracks using (track) window w as (partition by track order by s))"""


@query(_PRESENCE + ' select track, seg, round(start::double, 6) as start, round("end", 6) as "end", voiced from ps')
def presence_segments(spark, sf_dir):
    p = points(spark, sf_dir)
    return P.presence(_frames(p), E._tracks(p), F.col("value") > 250).select("track", F.col("seg").cast("bigint").alias("seg"), _r("start"), _r("end"), "voiced")


@query(_PRESENCE + """, vv as (select track, duration, min(start) as a, max("end") as b from ps where voiced and "end" > start group by track, duration),
 lg as (select *, lag(start) over (partition by track order by seg) as ps_, lag(voiced) over (partition by track order by seg) as pv from ps)
 select distinct track, round(t::double, 6) as t from (select track, least(duration, greatest(0, a - 1)) as t from vv union select track, least(duration, greatest(0, b + 1)) from vv
  union select track, least(duration, greatest(0, start - 1)) from lg where voiced and pv = false and start - ps_ >= 12 and least(duration, greatest(0, start - 1)) >= ps_)""")
def presence_cut_points(spark, sf_dir):
    p = points(spark, sf_dir)
    return P.presence_cuts(P.presence(_frames(p), E._tracks(p), F.col("value") > 250), 1.0, 12.0).select("track", _r("t")).distinct()


@query(_FR + _runs("eg", "fr", "value >= power(10, 44.0 / 20)") + """, ek as (select * from eg where "end" - start >= 8),
 ec as (select *, sum(o) over (partition by track order by start rows unbounded preceding) as c from (select *, case when start - lag("end") over (partition by track order by start) < 10 then 0 else 1 end as o from ek))
 select track, round(min(start), 6) as start, round(max("end"), 6) as "end" from ec group by track, c""")
def energy_gate(spark, sf_dir):
    return P.energy_gate(_frames(points(spark, sf_dir)), 44.0, 8.0, 10.0).select("track", _r("start"), _r("end"))


@query(_FR + _runs("sl", "fr", "20 * log10(value + 1e-12) < 40") + ' select track, round((start + "end") / 2, 6) as t from sl where not open and "end" - start >= 6')
def silence_midpoints(spark, sf_dir):
    from ..functions.scoring import decibels

    return P.silence_middles(_frames(points(spark, sf_dir)), decibels(F.col("value")) < 40, 6.0).select("track", _r("t"))


@query(""", mg as (select *, lead(start) over (partition by track order by start) as nx from (select m.track, start, "end", duration from merged m join tracks using (track))),
 gw as (select track, duration, "end" as a, coalesce(nx, duration) as b from mg union all select track, duration, 0, min(start) from mg group by track, duration),
 wd as (select track, greatest(0, a - 0.5) as start, least(duration, b + 0.5) as "end" from gw where b > a),
 wm as (select *, max("end") over (partition by track order by start, "end" rows between unbounded preceding and 1 preceding) as m from wd),
 wg as (select *, sum(case when m is null or start - m > 2.0 then 1 else 0 end) over (partition by track order by start, "end" rows unbounded preceding) as g from wm),
 wf as (select track, min(start) as start, max("end") as "end" from wg group by track, g having max("end") - min(start) >= 4)
 select track, round(start, 6) as start, round("end", 6) as "end" from wf union all select track, 0, round(duration, 6) from tracks where track not in (select track from wf)""")
def focus_gap_windows(spark, sf_dir):
    p = points(spark, sf_dir)
    return P.focus_gaps(E._regions(p), E._tracks(p), 0.5, 2.0, 4.0).select("track", _r("start"), _r("end"))


_PAUSES = """, pz as (select track, t as start, t + value / 100 as "end", least(value / 500, 1) as confidence, event_type as kind from p where event_type in ('view', 'error'))"""


def _pauses(p):
    return p.where("event_type in ('view', 'error')").select("track", F.col("t").alias("start"), (F.col("t") + F.col("value") / 100).alias("end"), F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"), F.col("event_type").alias("kind"))


@query(_PAUSES + """, pm as (select *, max("end") over (partition by track order by start, "end" rows between unbounded preceding and 1 preceding) as m from pz),
 pc as (select *, sum(case when m is null or start - m > 4.0 then 1 else 0 end) over (partition by track order by start, "end" rows unbounded preceding) as c from pm),
 pk as (select track, c, min(start) as start, max("end") as "end", max(confidence) as confidence, arg_min(kind, (start, "end")) as kind from pc group by track, c)
 select track, round(start, 6) as start, round("end", 6) as "end", round(confidence, 6) as confidence, kind from (select *, row_number() over (partition by track order by confidence desc, start) as rn from pk) where rn <= 12""")
def pause_compression(spark, sf_dir):
    return P.compress(_pauses(points(spark, sf_dir)), 4.0, 12).select("track", _r("start"), _r("end"), _r("confidence"), "kind")


@query(_PAUSES + """, pc as (select *, sum(o) over (partition by track order by start, "end" rows unbounded preceding) as c from (select *, case when start - lag("end") over (partition by track order by start, "end") <= 4.0 then 0 else 1 end as o from pz))
 select track, round(min(start), 6) as start, round(arg_max("end", (start, "end")), 6) as "end", round(max(confidence), 6) as confidence, case when count(*) > 1 then 'true_pause' else min(kind) end as kind from pc group by track, c""")
def adjacent_pause_merge(spark, sf_dir):
    return P.merge_adjacent(_pauses(points(spark, sf_dir)), 4.0).select("track", _r("start"), _r("end"), _r("confidence"), "kind")


_LOW = _FR + _runs("lr", "fr", "value < 180") + """, lp as (select track, row_number() over (partition by track order by start) as pause, start, "end", first, last, "end" - start as duration from lr),
mn as (select l.track, pause, avg(f0) filter (idx < first) as pre_f0, avg(f0) filter (idx between first and last) as in_f0, avg(value) filter (idx < first) as pre_rms, avg(value) filter (idx between first and last) as in_rms, avg(value) filter (idx > last) as post_rms,
  avg(centroid) filter (idx < first) as pre_c, avg(centroid) filter (idx between first and last) as in_c, stddev_pop(f0) filter (idx between first and last) as sd from lp l join fr on fr.track = l.track and idx between first - 3 and last + 3 group by l.track, pause),
pf as (select track, pause, case when pre_f0 > 0 then coalesce(1 - in_f0 / pre_f0, 0) else 0 end as f0_drop, coalesce((pre_rms - in_rms) / (pre_rms + 1e-10), 0) as energy_drop, coalesce((post_rms - in_rms) / (in_rms + 1e-10), 0) as energy_rise,
  coalesce(abs(pre_c - in_c) / (pre_c + 1e-10), 0) as centroid_shift, coalesce(1 - sd / (in_f0 + 1e-10), 0.5) as stability from mn),
pcf as (select *, least(1, (0.4 * least(1, f0_drop / 0.5) + 0.2 * (1 - stability) + 0.2 * least(1, centroid_shift / 0.3) + 0.2 * case when duration < 4 then 0.3 when duration >= 8 then least(1, duration) else 0.5 end) * (0.7 + 0.3 * least(1, energy_drop / 0.7)))::double as confidence from pf join lp using (track, pause))"""


def _low(p):
    from pyspark.sql import Window

    spans = P.flagged_until(_frames(p), F.col("value") < 180)
    return spans.select("track", F.row_number().over(Window.partitionBy("track").orderBy("start")).alias("pause"), "start", "end", "first", "last", (F.col("end") - F.col("start")).alias("duration"))


def _rated(p):
    low = _low(p)
    means = P.context_features(low, _frames(p), 3, ["f0", "rms", "centroid"])
    return P.pause_confidence(P.pause_features(means).join(low, ["track", "pause"]), 4.0, 8.0, (0.4, 0.2, 0.2, 0.2))


@query(_LOW + " select track, pause, round(f0_drop, 6) as f0_drop, round(energy_drop, 6) as energy_drop, round(energy_rise, 6) as energy_rise, round(centroid_shift, 6) as centroid_shift, round(stability, 6) as stability from pf")
def pause_features(spark, sf_dir):
    p = points(spark, sf_dir)
    return P.pause_features(P.context_features(_low(p), _frames(p), 3, ["f0", "rms", "centroid"])).select("track", "pause", *(_r(c) for c in ("f0_drop", "energy_drop", "energy_rise", "centroid_shift", "stability")))


@query(_LOW + " select track, pause, round(confidence, 6) as confidence from pcf")
def pause_confidence(spark, sf_dir):
    return _rated(points(spark, sf_dir)).select("track", "pause", _r("confidence"))


@query(_LOW + " select track, pause, case when confidence >= 0.5 then 'true_pause' when confidence <= 0.15 then 'breath' else 'true_pause' end as kind from pcf where confidence >= 0.5 or confidence <= 0.15 or duration >= 8")
def pause_classes(spark, sf_dir):
    return P.classify(_rated(points(spark, sf_dir)), 0.5, 0.15, 8.0, breaths=True).select("track", "pause", "kind")


@query(_LOW + """ select track, round((start + "end") / 2, 6) as t, round(least(1, greatest(0, case when confidence <= 0.15 then confidence * 0.6 else confidence end)), 6) as score, case when confidence <= 0.15 then 'breath' else 'acoustic_pause' end as source
 from pcf where confidence >= 0.5 or confidence <= 0.15 or duration >= 8""")
def pause_candidates(spark, sf_dir):
    kept = P.classify(_rated(points(spark, sf_dir)), 0.5, 0.15, 8.0, breaths=True)
    return P.as_candidates(kept.withColumn("cut", (F.col("start") + F.col("end")) / 2), 0.6).select("track", _r("t"), _r("score"), "source")


@query(_LOW + """, fm as (select track, idx, least(1, greatest(0, (least(1, greatest(0, avg(value) over w / max(value) over (partition by track))) + least(1, greatest(0, 1 - avg(flatness) over w)) + least(1, sum(onset) over w / 5.0)) / 3)) as mdd from fr window w as (partition by track order by idx rows between 10 preceding and 10 following))
 select c.track, pause, round(mdd, 6) as mdd, round(least(1, greatest(0, confidence * greatest(0.8, least(1.3, 1 + mdd * 0.25)))), 6) as confidence from pcf c join fm on fm.track = c.track and fm.idx = (first + last) // 2""")
def dynamics_boost(spark, sf_dir):
    p = points(spark, sf_dir)
    rated = _rated(p).withColumns({"mid": F.expr("(first + last) div 2"), "kind": F.lit("pause")})
    return P.boost(rated, _frames(p), 10, 0.25, 0.8, 1.3).select("track", "pause", _r("mdd"), _r("confidence"))


@query(_LOW + """, fg as (select *, quantile_cont(value, 0.05) over (partition by track) as fl from fr),
 g1 as (select l.track, pause, start, "end", fl, idx, row_number() over (partition by l.track, pause order by value, idx) as rn from lp l join fg on fg.track = l.track and idx between first and last),
 g2 as (select g.track, pause, start, "end", g.fl, value, t, row_number() over (partition by g.track, pause order by value, f.idx) as rn from g1 g join fr f on f.track = g.track and f.idx between g.idx and g.idx + 2 where g.rn = 1)
 select track, pause, round(case when value <= fl * 2 then t else (start + "end") / 2 end, 6) as cut, case when value <= fl * 2 then 'A' else 'B' end as grade from g2 where rn = 1""")
def precise_cut(spark, sf_dir):
    p = points(spark, sf_dir)
    return P.precise_cut(_low(p), _frames(p).select("track", "idx", "t", "value"), 2, 2.0).select("track", "pause", _r("cut"), "grade")


@query(""", ch as (select track, k as chunk, k * 90.0::double as s, k * 90.0 + 100::double as e, case when k > 0 then k * 90.0 + 5 else 0 end::double as es, k * 90.0 + 95::double as ee from tracks, unnest(range(0, cast(ceil(duration / 90) as bigint))) as u(k)),
 cs as (select r.track, chunk, greatest(r.start, s) as start, least(r."end", e) as "end", es, ee from regions r join ch on r.track = ch.track and r.start < e and r."end" > s)
 select track, chunk, round(case when start < es and "end" > es then start else greatest(start, es) end, 6) as start, round(least("end", ee), 6) as "end" from cs where "end" > es and start < ee and least("end", ee) - case when start < es and "end" > es then start else greatest(start, es) end > 1e-6""")
def chunk_span_clip(spark, sf_dir):
    from ..operators.intervals import overlapping

    p = points(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(1), F.ceil(F.col("duration") / 90)).cast("bigint") - 1)).alias("chunk")
    chunks = E._tracks(p).select("track", k, "duration").where("chunk < ceil(duration / 90)").select("track", "chunk", (F.col("chunk") * 90.0).alias("start"), (F.col("chunk") * 90.0 + 100).alias("end"), F.when(F.col("chunk") > 0, F.col("chunk") * 90.0 + 5).otherwise(0.0).alias("eff_start"), (F.col("chunk") * 90.0 + 95).alias("eff_end"))
    both = overlapping(E._regions(p), chunks, width=96.0)
    spans = both.select("track", F.col("r_chunk").alias("chunk"), F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))
    return P.clip_to_chunks(spans, chunks).select("track", "chunk", _r("start"), _r("end"))
