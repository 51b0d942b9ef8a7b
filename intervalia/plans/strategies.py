"""Cuts by bars and by valleys: a track's events are its levels, clicks its beats; vectors are waves of 64 samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import decibels
from ..operators import bars as G
from ..operators import pauses as P
from ..operators import strategies as S
from ..operators.finalise import wave_chunks
from . import events as E
from .bars import _CHORUS, _bars
from .events import _BASE, _r, points
from .pauses import _FR, _frames, _runs
from .signals import _WV, _waves

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = E.registrar(QUERIES, ORACLES)

VERSE, CHORUS = 3, 2


def _recursive(sql: str) -> str:
    return (_BASE + sql).replace("with e as", "with recursive e as", 1)


_MARKS = _FR + _runs("sl", "fr", "20 * log10(value + 1e-12) < 40") + f""", si as (select track, (start + "end") / 2 as t from sl where not open and "end" - start >= 6),
tw as (select track, duration, coalesce(w, 2.0::double) as w from tracks left join (select track, (max(a) - min(a)) / (count(*) - 1) as w from clicks group by track having count(*) > 1) using (track)),
ub as (select track, k as bar, k * w as start, (k + 1) * w as "end" from tw, unnest(range(0, greatest(1, ceil((duration + w) / w)::bigint - 1))) u(k)),
uk as (select b.track, bar, b.start, b."end", coalesce(avg(value), 0) as energy from ub b left join p on p.track = b.track and p.t >= b.start and p.t < b."end" group by all),
un as (select *, case when energy >= quantile_cont(energy, 0.6) over (partition by track) then {CHORUS} else {VERSE} end as need, exists (select 1 from si where si.track = uk.track and si.t > uk.start and si.t <= uk."end") as forced from uk),
mk as (select track, -1::bigint as bar, 0 as since, false as cut, 0.0::double as t from tw union all select un.track, un.bar, case when cut then 1 else since + 1 end, forced or case when cut then 1 else since + 1 end >= need, "end" from mk join un on un.track = mk.track and un.bar = mk.bar + 1)"""


def _marked(p):
    c = E._clicks(p).groupBy("track").agg(F.when(F.count("*") > 1, (F.max("a") - F.min("a")) / (F.count("*") - 1)).alias("width"))
    tracks = E._tracks(p).join(c, "track", "left").na.fill({"width": 2.0})
    silences = P.silence_middles(_frames(p), decibels(F.col("value")) < 40, 6.0)
    bars = G.bar_types(G.per_bar(S.uniform_bars(tracks), p.select("track", "t", F.col("value").alias("energy")), ["energy"]))
    return bars, silences, tracks.select("track", "duration")


@query()
def density_marks(spark, sf_dir):
    bars, silences, _ = _marked(points(spark, sf_dir))
    return S.density_marks(bars, silences, VERSE, CHORUS).select("track", "bar", _r("t"), "since", "cut")


ORACLES["density_marks"] = _recursive(_MARKS) + " select track, bar, round(t, 6) as t, since, cut from mk where bar >= 0"


@query()
def density_grid(spark, sf_dir):
    bars, silences, tracks = _marked(points(spark, sf_dir))
    return S.density_grid(bars, silences, tracks, VERSE, CHORUS, 10.0, 100).select("track", "sample")


_GRID_CUTS = _MARKS + """, al as (select track, t from mk where cut union select si.track, t from si join tracks using (track) where t > 0 and t < duration union select track, unnest([0.0::double, duration]) from tracks),
lg as (select track, min(t) as t from al group by track union all select lg.track, (select min(al.t) from al where al.track = lg.track and al.t - lg.t >= 10.0) from lg where lg.t is not null),
lk as (select track, t, row_number() over (partition by track order by t desc) as back, row_number() over (partition by track order by t) as ord from lg where t is not null),
dg as (select track, trunc(t * 100)::bigint as sample from lk join tracks using (track) where back > 1 and ord > 1 and trunc(t * 100) > 0 and trunc(t * 100) < trunc(duration * 100) union select track, trunc(unnest([0.0::double, duration]) * 100)::bigint from tracks)"""
ORACLES["density_grid"] = _recursive(_GRID_CUTS) + " select track, sample from dg"


@query()
def ratio_labels(spark, sf_dir):
    p = points(spark, sf_dir)
    bars, silences, tracks = _marked(p)
    w = F.lead("sample").over(S.Window.partitionBy("track").orderBy("sample"))
    cuts = S.density_grid(bars, silences, tracks, VERSE, CHORUS, 10.0, 100).withColumn("_to", w).where("_to is not null")
    seg = F.row_number().over(S.Window.partitionBy("track").orderBy("sample")) - 1
    segments = cuts.select("track", seg.cast("bigint").alias("seg"), (F.col("sample") / 100).alias("start"), (F.col("_to") / 100).alias("end"))
    frames = p.select("track", "t", F.when(F.col("event_type") != "error", F.col("value")).alias("vocal"), ((F.col("value") * 7) % 1500).alias("rest"))
    return S.ratio_labels(segments, frames).select("track", "seg", _r("vocal_rms"), _r("rest_rms"), "kind")


ORACLES["ratio_labels"] = _recursive(_GRID_CUTS) + """, sg as (select track, row_number() over (partition by track order by sample) - 1 as seg, sample / 100.0::double as start, lead(sample) over (partition by track order by sample) / 100.0::double as "end" from dg),
 sr as (select s.track, seg, coalesce(sqrt(avg(case when event_type != 'error' then value * value end)), 0) as v, coalesce(sqrt(avg(power((value * 7) % 1500, 2))), 0) as r, count(case when event_type != 'error' then 1 end) as n from sg s left join p on p.track = s.track and p.t >= s.start and p.t < s."end" where s."end" is not null group by s.track, seg)
 select track, seg, round(v, 6) as vocal_rms, round(r, 6) as rest_rms, case when n = 0 or v > 0.3 * r then 'human' else 'music' end as kind from sr"""


@query()
def beat_only_cuts(spark, sf_dir):
    p = points(spark, sf_dir)
    whole = G.chorus(_bars(p), 2)
    calm = G.quiet(p, decibels(F.col("value")), 2, 2, 20.0)
    inner = whole.withColumn("_last", F.max("bar").over(S.Window.partitionBy("track"))).where("bar < _last")
    quiet = S.as_of(inner.select("track", F.col("end").alias("t"), "bar"), calm, "quiet").select("track", "bar", "quiet")
    bars = inner.join(quiet, ["track", "bar"]).select("track", "bar", "start", "end", F.col("region").isNotNull().alias("high"), "quiet")
    cuts = p.where("event_type = 'view'").select("track", "t").distinct()
    return S.beat_only(bars, cuts, E._tracks(p), 1, 8.0, 100).select("track", "sample", "flag")


ORACLES["beat_only_cuts"] = _recursive(_CHORUS) + """, qd as (select *, 20 * log10(value + 1e-12) as db from p), qt as materialized (select track, t, idx, avg(db) over (partition by track order by idx rows between 2 preceding and 2 following) <= quantile_cont(db, 0.05) over (partition by track) + 20 as quiet from qd),
bo as materialized (select r.track, bar, start, "end", region is not null as high, duration, (select arg_max(quiet, (qt.t, qt.idx)) from qt where qt.track = r.track and qt.t <= r."end") as quiet, (select list(w.t order by w.t) from p w where w.track = r.track and event_type = 'view' and w.t >= r.start and w.t < r."end") as given
 from (select *, max(bar) over (partition by track) as lb from rgn) r join tracks using (track) where bar < lb),
br as (select track, -1::bigint as bar, 0 as c, 0.0::double as last, null::double as t, false as lib from tracks
 union all select track, bar, case when hit is null then c else 0 end, coalesce(hit, last), hit, high from (
  select track, bar, c, last, high, case when high then case when c >= 1 and "end" <= duration and "end" - last >= 8 and quiet then "end" end else coalesce(list_filter(given, lambda y: y > last + 8)[1], case when c >= 2 and "end" <= duration and "end" - last >= 8 then "end" end) end as hit
  from (select bo.*, br.c + 1 as c, br.last from br join bo on bo.track = br.track and bo.bar = br.bar + 1))),
bc as (select track, t, arg_min(lib, bar) as flag from br join tracks using (track) where t > 0 and t < duration group by track, t union all select track, unnest([0, duration]), false from tracks)
 select track, trunc(t * 100)::bigint as sample, arg_min(flag, t) as flag from bc group by track, trunc(t * 100)::bigint"""


@query()
def valley_refinement(spark, sf_dir):
    w = _waves(spark, sf_dir)
    n = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))).alias("n")
    at = F.when(F.col("n") == 0, 0).when(F.col("n") == 7, 64).otherwise(F.col("n") * 9 + F.col("track") % 3)
    words = w.select("track", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("track", ((F.col("k") * 17 + F.col("track") % 7) / 64).alias("start"), ((F.col("k") * 17 + F.col("track") % 7 + 6) / 64).alias("end"))
    boundaries = w.select("track", n).select("track", "n", at.cast("bigint").alias("at"))
    return S.valley_refined(boundaries, wave_chunks(w, 16, 10, ("samples",)), words, 16, 64.0, 6, 3, 3.0, 5).select("track", "n", "at", "refined")


ORACLES["valley_refinement"] = _recursive(_WV) + """, vb as (select track, k as n, case k when 0 then 0 when 7 then 64 else k * 9 + track % 3 end as pos, s from wv, unnest(range(0, 8)) u(k)),
vw as (select track, (k * 17 + track % 7) / 64.0::double as start, (k * 17 + track % 7 + 6) / 64.0::double as "end" from wv, unnest(range(0, 4)) u(k)),
vl as (select track, n, pos, lo, j, 20 * log10(sqrt(list_sum([power(v, 2) for v in s[j + 1:j + 3]]) / 3 + 1e-12) + 1e-12) as db, len from (select *, unnest(range(lo, hi - 2)) as j, hi - 2 - lo as len from (select *, greatest(0, pos - 6) as lo, least(64, pos + 6) as hi from vb) where hi - lo > 3)),
vo as (select track, n, arg_min(j, (db, j)) + 1 as offer, arg_min(db, (db, j)) as low, any_value(db) filter (j = lo + greatest(0, least(len - 1, pos - lo - 1))) as own from vl group by track, n),
vg as (select b.track, b.n, b.pos, case when own - low >= 3 and not exists (select 1 from vw where vw.track = b.track and vw.start < offer / 64.0::double and offer / 64.0::double < vw."end") and offer < lead(b.pos) over (partition by b.track order by b.n) - 5 and b.n > 0 then offer end as offer from vb b left join vo using (track, n)),
vr as (select track, n, pos, pos as refined from vg where n = 0 union all select vg.track, vg.n, vg.pos, case when vg.offer > vr.refined + 5 then vg.offer else vg.pos end from vr join vg on vg.track = vr.track and vg.n = vr.n + 1)
 select track, n, pos as at, refined from vr"""
