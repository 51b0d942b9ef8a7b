"""Profiles, tails, quiet places and batches: a track's events are its levels in hours; vectors are waves of 64 samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.scoring import decibels
from ..operators import matching as M
from ..operators import profiles as R
from ..operators.strategies import uniform_bars
from . import events as E
from .events import _BASE, _r, points
from .signals import _WV, _waves

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = E.registrar(QUERIES, ORACLES)

WIDTH = 60.0

_WINDOWS = f""", wr as (select *, coalesce(value > lag(value) over (partition by track order by idx), false) as rise from p),
wn as (select track, duration, k as win, k * {WIDTH / 2}::double as start, least(k * {WIDTH / 2}::double + {WIDTH}, duration) as "end" from tracks, unnest(range(0, greatest(1, ceil(duration / {WIDTH / 2})::bigint))) u(k)),
wf as (select *, case when "end" > start then c / ("end" - start) else 0 end as rises from (select w.track, win, w.start, w."end", coalesce(avg(value), 0) as level, coalesce(stddev_pop(value), 0) as spread, count(*) filter (rise) as c from wn w left join wr on wr.track = w.track and wr.t >= w.start and wr.t < w.start + {WIDTH} group by w.track, win, w.start, w."end")),
wu as (select *, """ + ", ".join(f"case when max({c}) over w > min({c}) over w then ({c} - min({c}) over w) / (max({c}) over w - min({c}) over w) else 0 end as u_{c}" for c in R.DENSITY) + f""" from wf window w as (partition by track)),
wc as (select *, u_level * 0.5 + u_spread * 0.3 + u_rises * 0.2 as density, u_spread * 0.7 + (u_level * 0.5 + u_spread * 0.3 + u_rises * 0.2) * 0.3 as complexity from wu),
wx as materialized (select *, 0.3 + 0.5 * complexity as x, lead(complexity) over (partition by track order by win) * 0.5 + 0.3 as nx, count(*) over (partition by track) as n from wc),
sm as (select track, win, case when n < 3 then x else 0.85 * x + 0.15 * nx end::double as y from wx where win = 0
 union all select wx.track, wx.win, case when n < 3 then x when nx is null then 0.85 * x + 0.15 * y else 0.8 * x + 0.1 * nx + 0.1 * y end::double from sm join wx on wx.track = sm.track and wx.win = sm.win + 1)"""
_PROFILE = (_BASE + _WINDOWS).replace("with e as", "with recursive e as", 1)


def _profiled(p):
    return R.profile(R.windows(p.select("track", "t", "idx", "value"), E._tracks(p), WIDTH), 0.3, 0.5)


@query()
def complexity_profile(spark, sf_dir):
    x = _profiled(points(spark, sf_dir))
    return x.select("track", "window", _r("start"), _r("end"), _r("level"), _r("spread"), _r("rises"), _r("density"), _r("complexity"), _r("threshold"))


ORACLES["complexity_profile"] = _PROFILE + ' select track, win as "window", round(start, 6) as start, round("end", 6) as "end", round(level, 6) as level, round(spread, 6) as spread, round(rises, 6) as rises, round(density, 6) as density, round(complexity, 6) as complexity, round(y, 6) as threshold from wx join sm using (track, win)'


@query()
def window_thresholds(spark, sf_dir):
    p = points(spark, sf_dir)
    asked = p.select("track", F.col("event_id").alias("point"), (F.col("t") + F.when(F.col("event_id") % 10 == 0, 500).otherwise(0)).alias("t"))
    return R.window_at(asked, _profiled(p), 0.4, WIDTH).select("track", "point", _r("t"), "window", _r("threshold"))


ORACLES["window_thresholds"] = _PROFILE + """, wt as (select track, event_id as point, t + case when event_id % 10 = 0 then 500 else 0 end as t from p),
 wh as (select w.track, point, any_value(w.t) as t, min(win) as win from wt w left join wx on wx.track = w.track and wx.start <= w.t and w.t <= wx."end" group by w.track, point)
 select wh.track, point, round(t, 6) as t, wh.win as "window", round(coalesce(y, 0.4), 6) as threshold from wh left join sm using (track, win)"""

_EDGES = (0, 5, 12, 30, 36, 50, 64)


@query(_WV + """, te as (select track, k as seg, ([0, 5, 12, 30, 36, 50, 64])[k + 1] as a, ([0, 5, 12, 30, 36, 50, 64])[k + 2] as b, (track + k) % 2 = 0 as human, case when (track + k) % 3 = 0 then 0.05 else 1 end::double as g, s from wv, unnest(range(0, 6)) u(k)),
 ts as (select track, seg, a, b, human, sqrt(list_sum([power(v * g, 2) for v in s[a + 1:b]]) / (b - a) + 1e-12) as rms, list_max([abs(v * g) for v in s[a + 1:b]]) as peak from te),
 tw as (select *, coalesce(human and not lead(human) over (partition by track order by seg) and b - a < 10 and rms <= 0.12 * (quantile_cont(rms, 0.5) filter (human and b - a >= 10 and rms > 0) over (partition by track)) and peak <= 0.18 * (quantile_cont(peak, 0.5) filter (human and b - a >= 10 and peak > 0) over (partition by track)), false) as absorbed from ts)
 select track, row_number() over (partition by track order by g) - 1 as seg, start, "end", human, absorbed from (select track, seg + absorbed::int as g, min(a) / 64.0::double as start, max(b) / 64.0::double as "end", bool_and(human) and not bool_or(absorbed) as human, bool_or(absorbed) as absorbed from tw group by track, seg + absorbed::int)""")
def weak_tails(spark, sf_dir):
    w = _waves(spark, sf_dir)
    seg = F.explode(F.array(*(F.struct(F.lit(k).cast("bigint").alias("seg"), F.lit(a / 64).alias("start"), F.lit(b / 64).alias("end")) for k, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))))).alias("x")
    segments = w.select("track", seg).select("track", "x.*").withColumn("human", (F.col("track") + F.col("seg")) % 2 == 0)
    of = F.lit(len(_EDGES) - 2).cast("int")
    for k, b in reversed(list(enumerate(_EDGES[1:]))):
        of = F.when(F.col("i") < b, k).otherwise(of)
    samples = w.select("track", F.posexplode("samples").alias("i", "v")).select("track", (F.col("i") / 64).alias("t"), (F.col("v") * F.when((F.col("track") + of) % 3 == 0, 0.05).otherwise(1.0)).alias("value"))
    return R.absorb_weak_tails(R.segment_peaks(segments, samples), 10 / 64)


@query(""", qf as (select track, idx - 1 as frame, 20 * log10(value + 1e-12) as db from p), ql as (select *, quantile_cont(db, 0.05) over (partition by track) as fl from qf),
 qn as (select *, min(case when db <= fl + case when fl > -30 then 3 else 2 end then frame end) over (partition by track order by frame rows between current row and unbounded following) as nx from ql),
 qp as (select track, event_id as point, t, floor(t / 2)::bigint as frame from p)
 select q.track, point, round(case when n.frame is null or nx = n.frame then t when nx is null then -1 else nx * 2.0::double end, 6) as quiet from qp q left join qn n on n.track = q.track and n.frame = q.frame""")
def next_quiet(spark, sf_dir):
    p = points(spark, sf_dir)
    frames = p.select("track", (F.col("idx") - 1).cast("bigint").alias("frame"), decibels(F.col("value")).alias("db"))
    return R.next_quiet(p.select("track", F.col("event_id").alias("point"), "t"), frames, 2.0, 0.05, 2.0).select("track", "point", _r("quiet"))


@query("""select track, case when track % 7 = 3 then null else count(*) end as levels, case when track % 7 = 3 then null else round(median(value), 6) end as middle, case when track % 7 = 3 then 'ValueError: no wave of track ' || track end as error from p group by track""")
def batch_results(spark, sf_dir):
    """Each track on its own; those whose number leaves 3 over 7 have a broken wave."""

    def work(x: dict[str, np.ndarray]) -> list:
        if x["track"][0] % 7 == 3:
            raise ValueError(f"no wave of track {x['track'][0]}")
        return [x["track"][:1], np.array([len(x["value"])]), np.array([round(float(np.median(x["value"])), 6)])]

    return R.each_track(points(spark, sf_dir).select("track", "idx", "value"), ["idx"], work, "track bigint, levels bigint, middle double")


@query(""", sg as (select track, k as seg, k * 30.0::double as start, (k + 1) * 30.0::double as "end" from tracks, unnest(range(0, greatest(1, ceil((duration + 30) / 30)::bigint - 1))) u(k) where duration > 0),
 sw as (select s.track, seg, w.start, w."end", case when event_id % 4 = 0 then '歌' else 'w' end || event_id % 5 as text from sg s join words w on w.track = s.track and least(w."end", s."end") - greatest(w.start, s.start) > 0 and least(w."end", s."end") - greatest(w.start, s.start) >= 0.5 * greatest(w."end" - w.start, 1e-9)),
 sl as (select track, seg, case when bool_and(text like '歌%') then string_agg(text, '' order by start, "end", text) else string_agg(text, ' ' order by start, "end", text) end as text, min(start) as first, arg_max("end", (start, "end")) as last, count(*) as words from sw group by track, seg)
 select track, seg, text, round(first, 6) as first, round(last, 6) as last, coalesce(words, 0) as words from sg left join sl using (track, seg)""")
def segment_lyrics(spark, sf_dir):
    p = points(spark, sf_dir)
    segments = uniform_bars(E._tracks(p).withColumn("width", F.lit(30.0))).withColumnRenamed("bar", "seg")
    text = F.concat(F.when(F.col("event_id") % 4 == 0, "歌").otherwise("w"), (F.col("event_id") % 5).cast("string"))
    words = E._words(p).select("track", text.alias("text"), "start", "end")
    return M.segment_lyrics(segments, words).select("track", "seg", "text", _r("first"), _r("last"), "words")
