"""Queries over bars and chunks; clicks are beats, values are levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as G
from ..operators import chunks as K
from ..operators import matching as M
from . import events as E
from .events import _BASE, _r, points

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = E.registrar(QUERIES, ORACLES)

_GRID = """, bt as (select track, a, row_number() over (partition by track order by a) - 1 as n from clicks where track % 4 != 0 or a < 60),
bf as (select track, count(*) as c, (max(a) - min(a)) / greatest(1, count(*) - 1) as mean from bt group by track),
tf as (select track, duration, coalesce(c, 0) as c, mean from tracks left join bf using (track)),
g1 as (select track, n // 4 as bar, a as start, coalesce(lead(a) over (partition by track order by a), duration) as "end" from bt join tf using (track) where c >= 4 and n % 4 = 0),
g2 as (select track, k as bar, k * w as start, (k + 1) * w as "end" from (select track, duration, case when c >= 2 then mean * 4 else 2.0::double end as w from tf where c < 4), unnest(range(0, cast(greatest(1, ceil((duration + w) / w) - 1) as bigint))) u(k)),
bars as (select * from g1 union all select * from g2),
pb as (select b.track, bar, start, b."end", coalesce(avg(value), 0) as energy, coalesce(avg(value % 29), 0) as centroid, coalesce(avg(value % 13), 0) as bandwidth from bars b left join p on p.track = b.track and p.t >= b.start and p.t < b."end" group by b.track, bar, start, b."end"),
th as (select *, quantile_cont(energy, 0.7) over (partition by track) as threshold from pb)"""


def _beats(p):
    return E._clicks(p).where("track % 4 != 0 or a < 60").select("track", "a")


def _bars(p):
    frames = p.select("track", "t", F.col("value").alias("energy"), (F.col("value") % 29).alias("centroid"), (F.col("value") % 13).alias("bandwidth"))
    return G.per_bar(G.grid(_beats(p), E._tracks(p)), frames, ["energy", "centroid", "bandwidth"])


@query(_GRID + ' select track, bar, round(start, 6) as start, round("end", 6) as "end" from bars')
def bar_grid(spark, sf_dir):
    p = points(spark, sf_dir)
    return G.grid(_beats(p), E._tracks(p)).select("track", "bar", _r("start"), _r("end"))


@query(_GRID + " select track, bar, round(energy, 8) as energy, round(centroid, 8) as centroid, round(bandwidth, 8) as bandwidth from pb")
def bar_features(spark, sf_dir):
    return _bars(points(spark, sf_dir)).select("track", "bar", _r("energy", 8), _r("centroid", 8), _r("bandwidth", 8))


@query(_GRID + " select track, bar, round(threshold, 8) as threshold, energy >= threshold as high, round(tempo, 6) as tempo from th left join (select track, case when count(*) > 1 then 60 * (count(*) - 1) / (max(a) - min(a)) else 0 end as tempo from bt group by track) using (track)")
def beat_analysis(spark, sf_dir):
    p = points(spark, sf_dir)
    tempo, bars = G.analysis(_beats(p), _bars(p))
    return bars.join(tempo, "track", "left").select("track", "bar", _r("threshold", 8), "high", _r("tempo"))


_CHORUS = _GRID + """, un as (select *, stddev_pop(energy) over w / (avg(energy) over w + 1e-6) as cv, case when max(energy) over w - min(energy) over w > 1e-6 then (energy - min(energy) over w) / (max(energy) over w - min(energy) over w) else 0 end as e,
 case when max(centroid) over w - min(centroid) over w > 1e-6 then (centroid - min(centroid) over w) / (max(centroid) over w - min(centroid) over w) else 0 end as c, case when max(bandwidth) over w - min(bandwidth) over w > 1e-6 then (bandwidth - min(bandwidth) over w) / (max(bandwidth) over w - min(bandwidth) over w) else 0 end as b from pb window w as (partition by track)),
sc as (select *, e * case when cv < 0.15 then 0.3 when cv > 0.4 then 0.6 else 0.5 end::double + c * case when cv < 0.15 then 0.4 when cv > 0.4 then 0.2 else 0.25 end::double + b * case when cv < 0.15 then 0.3 when cv > 0.4 then 0.2 else 0.25 end::double as score from un),
rg1 as (select *, score >= quantile_cont(score, 0.6) over (partition by track) as hi from sc),
rg2 as (select *, sum(case when hi is not distinct from ph then 0 else 1 end) over (partition by track order by bar rows unbounded preceding) as run from (select *, lag(hi) over (partition by track order by bar) as ph from rg1)),
rgn as (select *, case when hi and count(*) over (partition by track, run) >= 2 then run end as region, row_number() over (partition by track, run order by bar) - 1 as place from rg2)"""


@query(_CHORUS + " select track, bar, round(score, 6) as score, region from rgn")
def chorus_regions(spark, sf_dir):
    return G.chorus(_bars(points(spark, sf_dir)), 2).select("track", "bar", _r("score"), "region")


@query(_CHORUS + " select track, bar, round(start, 6) as t, 0.3::double as score, 'beat' as source from rgn join tracks using (track) where region is not null and place % 2 = 0 and start > 0 and start < duration")
def beat_candidates(spark, sf_dir):
    p = points(spark, sf_dir)
    return G.beat_candidates(G.chorus(_bars(p), 2), E._tracks(p), 2, 0.3).select("track", "bar", _r("t"), "score", "source")


@query(_GRID + " select track, bar, case when energy >= quantile_cont(energy, 0.8) over w then 'chorus_peak' when energy >= quantile_cont(energy, 0.6) over w then 'chorus' else 'verse' end as kind from pb window w as (partition by track)")
def bar_types(spark, sf_dir):
    return G.bar_types(_bars(points(spark, sf_dir))).select("track", "bar", "kind")


@query(_GRID + " select event_id, (select max(bar) from bars b where b.track = p.track and b.start <= p.t) as bar from p")
def holding_bar(spark, sf_dir):
    p = points(spark, sf_dir)
    return G.holding_bar(p.select("track", "t", "event_id"), G.grid(_beats(p), E._tracks(p))).select("event_id", "bar")


@query(""", qd as (select *, 20 * log10(value + 1e-12) as db from p) select event_id, avg(db) over (partition by track order by idx rows between 2 preceding and 2 following) <= quantile_cont(db, 0.05) over (partition by track) + 20 as quiet from qd""")
def quiet_windows(spark, sf_dir):
    from ..functions.scoring import decibels

    return G.quiet(points(spark, sf_dir), decibels(F.col("value")), 2, 2, 20.0).select("event_id", "quiet")


@query(""", cf as (select track, floor(a * 2) / 2 as t, n % 2 = 0 as flag, n from clicks), f1 as (select track, t, arg_min(flag, n) as flag from cf group by track, t),
 al as (select f.track, t, flag from f1 f join tracks using (track) where t > 0 and t < duration union all select track, unnest([0, duration]), false from tracks)
 select track, trunc(t * 100)::bigint as sample, arg_min(flag, t) as flag from al group by track, trunc(t * 100)::bigint""")
def converted_cuts(spark, sf_dir):
    p = points(spark, sf_dir)
    cuts = E._clicks(p).select("track", (F.floor(F.col("a") * 2) / 2).alias("t"), (F.col("n") % 2 == 0).alias("flag"), "n")
    return G.converted(cuts, E._tracks(p), 100).select("track", "sample", "flag")


@query(""", nn as (select track, duration, case when duration / greatest(1, ceil(duration / 80)) < 60 and ceil(duration / 80) > 1 then greatest(1, floor(duration / 60)) else greatest(1, ceil(duration / 80)) end::bigint as n from tracks)
 select track, k as ord, round(case when k = n then duration else round(k * duration / n, 9) end, 6) as t from nn, unnest(range(0, n + 1)) u(k)""")
def uniform_split(spark, sf_dir):
    return G.uniform_split(E._tracks(points(spark, sf_dir)), 60.0, 80.0).select("track", "ord", _r("t"))


_SCHED = """, sc as (select track, k as chunk, duration, k * 90.0::double as start, least(k * 90.0::double + 100, duration) as "end" from (select track, duration, unnest(range(0, case when duration <= 100 then 0 else ceil((duration - 100) / 90) end::bigint + 1)) as k from tracks)),
ch as (select track, chunk, start, "end", case when chunk > 0 then 5 else 0 end::double as halo_left, case when "end" < duration then 5 else 0 end::double as halo_right, start + case when chunk > 0 then 5 else 0 end as es, "end" - case when "end" < duration then 5 else 0 end as ee from sc)"""


@query(_SCHED + ' select track, chunk, round(start, 6) as start, round("end", 6) as "end", halo_left, halo_right, round(es, 6) as eff_start, round(ee, 6) as eff_end from ch')
def chunk_schedule(spark, sf_dir):
    x = K.schedule(E._tracks(points(spark, sf_dir)), 100.0, 10.0, 5.0)
    return x.select("track", "chunk", _r("start"), _r("end"), "halo_left", "halo_right", _r("eff_start"), _r("eff_end"))


@query(""", rp as (select track, duration, unnest(range(0, case when duration <= 60 then 0 else ceil((duration - 60) / 52) end::bigint + 1)) as k from tracks where duration > 0) select track, k as chunk, round(k * 52.0::double, 6) as t0, round(least(k * 52.0::double + 60, duration), 6) as t1 from rp""")
def recognition_chunks(spark, sf_dir):
    return K.recognition_plan(E._tracks(points(spark, sf_dir)), 75.0, 8.0).select("track", "chunk", _r("t0"), _r("t1"))


@query(_SCHED + " select p.event_id, chunk from p join ch on p.track = ch.track and p.t >= es and p.t < ee")
def halo_trim(spark, sf_dir):
    p = points(spark, sf_dir)
    return K.trimmed(p, K.schedule(E._tracks(p), 100.0, 10.0, 5.0)).select("event_id", "chunk")


@query(""", sw as (select track, k as chunk, k * 60.0::double as start, least(k * 60.0::double + 100, duration) as "end", case when k > 0 then k * 60.0 + 5 else 0 end::double as es, least(k * 60.0::double + 100, duration) - case when k * 60.0 + 100 < duration then 5 else 0 end as ee from (select track, duration, unnest(range(0, case when duration <= 100 then 0 else ceil((duration - 100) / 60) end::bigint + 1)) as k from tracks))
 select p.track, p.idx, round(coalesce(avg(value + chunk), 0), 8) as value, count(chunk) as weight from p left join sw on p.track = sw.track and p.t >= es and p.t < ee group by p.track, p.idx""")
def overlap_stitch(spark, sf_dir):
    p = points(spark, sf_dir)
    chunks = K.schedule(E._tracks(p), 100.0, 40.0, 5.0)
    return K.stitched(p, chunks, F.col("value") + F.col("chunk")).select("track", "idx", _r("value", 8), "weight")


_HEARD = """, hc as (select track, k as chunk, k * 52.0::double as t0, round(least(k * 52.0::double + 60, duration), 9) as t1 from (select track, duration, unnest(range(0, case when duration <= 60 then 0 else ceil((duration - 60) / 52) end::bigint + 1)) as k from tracks where duration > 0)),
hw as (select w.track, chunk, t0, t1, w.start, w."end", 'w' || (event_id % 3) as text, case when event_id % 4 = 0 then null else (event_id * 7 + chunk * 3) % 10 / 10.0::double end as confidence from words w join hc on w.track = hc.track and w.start >= t0 and w.start < t1),
ho as (select *, (start + "end") / 2 as mid, abs((start + "end") / 2 - (t0 + t1) / 2) as off from hw),
hp as (select *, case when text = lag(text) over w and (least("end", lag("end") over w) > greatest(start, lag(start) over w) or abs(mid - lag(mid) over w) <= 0.25) then 0 else 1 end as o from ho window w as (partition by track order by start, "end", text, chunk)),
hq as (select *, sum(o) over (partition by track order by start, "end", text, chunk rows unbounded preceding) as g from hp)"""


@query(_HEARD + ' select track, round(start, 6) as start, round("end", 6) as "end", text, confidence from (select *, row_number() over (partition by track, g order by coalesce(confidence, -1) desc, off, start, "end", chunk) as rn from hq) where rn = 1')
def overlap_word_merge(spark, sf_dir):
    p = points(spark, sf_dir)
    chunks = K.recognition_plan(E._tracks(p), 75.0, 8.0)
    held = K._in_chunks(E._words(p).withColumnsRenamed({"start": "t", "end": "w_end"}), chunks.withColumns({"start": F.col("t0"), "end": F.col("t1")}))
    heard = held.where("t < t1").select("track", "chunk", (F.col("t") - F.col("t0")).alias("start"), (F.col("w_end") - F.col("t0")).alias("end"), F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("text"), F.when(F.col("event_id") % 4 == 0, None).otherwise((F.col("event_id") * 7 + F.col("chunk") * 3) % 10 / 10.0).alias("confidence"))
    return K.merged_words(heard, chunks).select("track", _r("start"), _r("end"), "text", "confidence")


_ADJ = """, aj as (select track, idx as n, t as raw, t + (value % 20 - 10) / 10 as final from p where event_type = 'click')"""


def _adjusted(p):
    return p.where("event_type = 'click'").select("track", F.col("idx").alias("n"), F.col("t").alias("raw"), (F.col("t") + (F.col("value") % 20 - 10) / 10).alias("final"))


@query(_ADJ + """, ai as (select *, exists(select 1 from words w where w.track = aj.track and w.start < raw and raw < w."end") as ri, exists(select 1 from words w where w.track = aj.track and w.start < final and final < w."end") as fi from aj)
 select track, n, round(case when fi and not ri then raw else final end, 6) as final, fi and not ri as restored from ai""")
def guard_restore(spark, sf_dir):
    p = points(spark, sf_dir)
    return M.restored(_adjusted(p), E._words(p)).select("track", "n", _r("final"), "restored")


@query(""", mc as (select track, event_id, floor(t / 6) * 6 as t from p), mn as (select track, floor(t / 6) * 6 as t, idx as n, event_type as note from p where event_type != 'view')
 select event_id, arg_max(note, n) as note from mc left join mn on mc.track = mn.track and round(mc.t, 6) = round(mn.t, 6) group by event_id""")
def metadata_lookup(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("t", F.floor(F.col("t") / 6) * 6.0)
    notes = p.where("event_type != 'view'").select("track", "t", F.col("idx").alias("n"), F.col("event_type").alias("note"))
    return M.with_metadata(p.select("track", "t", "event_id"), notes).select("event_id", "note")


@query(_ADJ + """, kp as (select track, event_id, t from p where event_type = 'view') select event_id, round(arg_min(final, (abs(kp.t - final), final, n)), 6) as final, round(arg_min(raw, (abs(kp.t - final), final, n)), 6) as raw from kp join aj using (track) group by event_id""")
def nearest_adjustment(spark, sf_dir):
    p = points(spark, sf_dir)
    kept = p.where("event_type = 'view'").select("track", "t", "event_id")
    return M.nearest_adjustment(kept, _adjusted(p)).where("final is not null").select("event_id", _r("final"), _r("raw"))


@query(""", re as (select track, t as a, event_id % 2 = 0 as flag from p where event_type = 'click'), rl as (select *, flag and a != max(a) over (partition by track) as f from re),
 ve as (select track, event_id, t from p where event_type = 'view') select event_id, coalesce(arg_min(f, (abs(ve.t - a), a)), false) as flag from ve left join rl using (track) group by event_id""")
def flag_remap(spark, sf_dir):
    p = points(spark, sf_dir)
    raw = p.where("event_type = 'click'").select("track", F.col("t").alias("a"), (F.col("event_id") % 2 == 0).alias("flag"))
    ends = p.where("event_type = 'view'").select("track", "t", "event_id")
    return M.remapped_flags(ends.select("track", "t"), raw).join(ends, ["track", "t"]).select("event_id", "flag")


@query(""", ra as (select track, (t * 1000)::bigint as s from p), rb as (select track, (t * 1000)::bigint + idx % 5 as s from p),
 na as (select track, s, row_number() over (partition by track order by s) as n from (select distinct * from ra)), nb as (select track, s, row_number() over (partition by track order by s) as n from (select distinct * from rb))
 select track, n, round(abs(na.s - nb.s) * 1000.0::double / 1000, 6) as ms from na join nb using (track, n)""")
def positional_difference(spark, sf_dir):
    p = points(spark, sf_dir)
    sample = F.rint(F.col("t") * 1000).cast("bigint")
    return M.positional_difference(p.select("track", sample.alias("sample")), p.select("track", (sample + F.col("idx") % 5).alias("sample")), 1000, strict=False).select("track", F.col("n").cast("bigint").alias("n"), _r("ms"))


@query(""" select track, count(*) as edges, round(min(t), 6) as first_t from (select distinct track, t from (select track, "end" as t from words union all select track, unnest([start, "end"]) from regions) where t > 0) group by track""")
def boundary_edges(spark, sf_dir):
    p = points(spark, sf_dir)
    _, edges = M.boundaries_of(E._words(p), E._words(p), E._regions(p))
    return edges.groupBy("track").agg(F.count("*").alias("edges"), F.round(F.min("t"), 6).alias("first_t"))


@query(_ADJ + """, se as (select track, t as a from (select *, max(idx) over (partition by track) as m from p where event_type = 'view') where idx < m) select track, n from aj where exists(select 1 from se where se.track = aj.track and abs(se.a - aj.final) <= 2.0)""")
def adjustment_filter(spark, sf_dir):
    p = points(spark, sf_dir)
    segments = p.where("event_type = 'view'").select("track", F.col("idx").alias("seg"), F.col("t").alias("end"))
    return M.near_boundaries(_adjusted(p), segments, 2.0).select("track", "n")


_REC = _BASE.replace("with e as", "with recursive e as", 1)
_SNAP = _REC + _GRID + """, hb as (select track, bar, start, energy >= quantile_cont(energy, 0.5) over (partition by track) as high from pb),
qb as (select track, a, a * 10 - floor(a * 10) < 0.8 as quiet from bt), rc as (select track, least(4.0, 0.4 * (max(a) - min(a)) / nullif(count(*) - 1, 0)) as reach from qb group by track),
vc as (select track, event_id, t from p where event_type in ('view', 'error')),
vn as (select v.track, event_id, t, arg_min(a, (abs(t - a), a)) as b from vc v left join (select * from qb where quiet) q using (track) group by v.track, event_id, t),
vs as (select n.*, coalesce((select high from hb where hb.track = n.track and hb.start <= n.t order by bar desc limit 1) and abs(n.t - b) <= coalesce(reach, 4.0), false) as go from vn n left join rc using (track)),
vo as (select track, t, case when go then b else t end as "to", go, row_number() over (partition by track order by t) as n from vs),
gs as (select track, 0::bigint as n, 0.0::double as last, null::double as took, false as go from tracks
 union all select o.track, o.n, case when o."to" - last >= 6 then o."to" else last end, case when o."to" - last >= 6 then o."to" end, o.go from gs join vo o on o.track = gs.track and o.n = gs.n + 1)"""


def _snap_parts(p):
    bars = _bars(p)
    high = F.col("energy") >= F.percentile("energy", F.lit(0.5)).over(G.Window.partitionBy("track"))
    beats = _beats(p).withColumn("quiet", F.col("a") * 10 - F.floor(F.col("a") * 10) < 0.8)
    return p.where("event_type in ('view', 'error')").select("track", "t"), beats, bars.withColumn("high", high)


@query()
def chorus_snap(spark, sf_dir):
    return G.snapped_cuts(*_snap_parts(points(spark, sf_dir)), 4.0, 6.0).select("track", _r("t"), "snapped")


ORACLES["chorus_snap"] = _SNAP + " select track, round(took, 6) as t, go as snapped from gs where took is not null"


@query()
def inner_cut_filter(spark, sf_dir):
    p = points(spark, sf_dir)
    return G.inner_cuts(p.select("track", "t"), E._tracks(p), 9.0, 24.0).select("track", _r("t"))


ORACLES["inner_cut_filter"] = _REC + """, ic as (select track, t from p join tracks using (track) where t > least(24, duration / 2) and t < duration - least(24, duration / 2)),
 r as (select track, min(t) as t from ic group by track union all select r.track, (select min(ic.t) from ic where ic.track = r.track and ic.t - r.t >= 9.0) from r where r.t is not null) select track, round(t, 6) as t from r where t is not null"""


@query(" select event_id, floor(t * 100)::bigint as inside, round_even(t * 100, 0)::bigint as nearest, greatest(0, round_even((floor(t * 100) / 100 - 0.25) * 44, 0))::bigint as mapped from p")
def time_to_samples(spark, sf_dir):
    return G.samples_at(points(spark, sf_dir).select("track", "t", "event_id"), 100, 44, 0.25).select("event_id", "inside", "nearest", "mapped")
