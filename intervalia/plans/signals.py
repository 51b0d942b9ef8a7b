"""Queries over frame features and waves; embeddings are waves of 64 samples a second."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import waveforms as W
from . import events as E
from .events import _BASE, _r, points

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = E.registrar(QUERIES, ORACLES)

_FR = """, fr as (select track, event_id, idx, t, value, (event_id % 7) / 7.0::double as flatness, case when event_type = 'signup' then 1 else 0 end::double as onset, value % 13 / 13 as clarity from p)"""


def _frames(p):
    return p.select("track", "event_id", "idx", "t", "value", (F.col("event_id") % 7 / 7.0).alias("flatness"), F.when(F.col("event_type") == "signup", 1.0).otherwise(0.0).alias("onset"), (F.col("value") % 13 / 13).alias("clarity"))


@query(_FR + """ select event_id, round(s[least(len(s), floor(len(s) * 0.3)::int + 1)], 6) as floor from (select event_id, list_sort(list(value) over (partition by track order by idx rows between 5 preceding and 5 following)) as s from fr)""")
def rolling_percentile_floor(spark, sf_dir):
    return X.rolling_floor(_frames(points(spark, sf_dir)), 5, 0.3).select("event_id", _r("floor"))


@query(_FR + """ select event_id, round(least(1, greatest(0, 0.5::double * (value / max(value) over w) + 0.3::double * (1 - flatness) + 0.2::double * case when max(onset) over w > 0 then onset / max(onset) over w else 0 end)), 6) as mdd from fr window w as (partition by track)""")
def dynamic_density(spark, sf_dir):
    return X.dynamics(_frames(points(spark, sf_dir))).select("event_id", _r("mdd"))


@query(_FR + """ select event_id, round(case when hi > lo then least(1, greatest(0, (value - lo) / (hi - lo))) else 0 end, 6) as scaled from (select *, quantile_cont(value, 0.1) over (partition by track) as lo, quantile_cont(value, 0.9) over (partition by track) as hi from fr)""")
def quantile_density(spark, sf_dir):
    return X.quantile_scaled(_frames(points(spark, sf_dir))).select("event_id", _r("scaled"))


@query(_FR + """, gz as (select *, lag(value - 250) over w as b, lead(value - 250) over w as a from fr window w as (partition by track order by idx)),
 gt as (select *, case when (value - 250 >= 0) != (b >= 0) then 1.0 else 0.0 end as turn from gz)
 select event_id, round(case when b is null then coalesce(a - (value - 250), 0) when a is null then value - 250 - b else (a - b) / 2 end, 6) as gradient, round(avg(turn) over (partition by track order by idx rows between 2 preceding and 2 following), 6) as crossings from gt""")
def energy_gradient(spark, sf_dir):
    centred = _frames(points(spark, sf_dir)).withColumn("value", F.col("value") - 250)
    return X.gradients(centred).select("event_id", _r("gradient"), _r("crossings"))


@query(_FR + """ select a.event_id, round(sum(b.value * exp(-0.5 * power((a.idx - b.idx) / 2.0::double, 2))) / sum(exp(-0.5 * power((a.idx - b.idx) / 2.0::double, 2))), 6) as smooth from fr a join fr b on a.track = b.track and abs(a.idx - b.idx) <= 8 group by a.event_id""")
def gaussian_smooth(spark, sf_dir):
    return X.gaussian(_frames(points(spark, sf_dir)), 2.0, 8).select("event_id", _r("smooth"))


_W = "(partition by track order by idx rows between {h} preceding and {h} following)"


@query(_FR + f""", m0 as (select *, value / max(value) over (partition by track) > 0.3 and clarity > 0.3 as a from fr), m1 as (select *, bool_or(a) over {_W.format(h=2)} as b from m0),
 m2 as (select *, bool_and(b) over {_W.format(h=2)} and count(*) over {_W.format(h=2)} = 5 as c from m1), m3 as (select *, bool_and(c) over {_W.format(h=1)} and count(*) over {_W.format(h=1)} = 3 as d from m2)
 select event_id, bool_or(d) over {_W.format(h=1)} as voiced from m3""")
def voice_mask(spark, sf_dir):
    from pyspark.sql import Window

    share = F.col("value") / F.max("value").over(Window.partitionBy("track"))
    return X.voice_mask(_frames(points(spark, sf_dir)), (share > 0.3) & (F.col("clarity") > 0.3)).select("event_id", "voiced")


@query(_FR + """, bs as (select *, value - lag(value) over (partition by track order by idx) as step from fr)
 select event_id, coalesce(step < -2 * stddev_pop(step) over w, false) as "drop", value < (quantile_cont(value, 0.2) filter (value > 0) over w) as soft, clarity < 0.5 * avg(clarity) over w as unclear from bs window w as (partition by track)""")
def breath_features(spark, sf_dir):
    return X.breaths(_frames(points(spark, sf_dir))).select("event_id", "drop", "soft", "unclear")


@query(_FR + """, lk as (select event_id, track, t, least(mx, greatest(mn, round_even(t / 10, 0)::int)) as pos from fr join (select track, min(idx) as mn, max(idx) as mx from fr group by track) using (track)),
 nb as (select track, idx, avg(value) over w as level, sum(onset) over w as onsets from fr window w as (partition by track order by idx rows between 3 preceding and 3 following))
 select l.event_id, pos as idx, round(level, 8) as level, onsets from lk l join nb on nb.track = l.track and nb.idx = pos""")
def feature_lookup(spark, sf_dir):
    f = _frames(points(spark, sf_dir))
    return X.looked_up(f.select("track", "t", "event_id"), f, 10.0, 3).select("event_id", "idx", _r("level", 8), "onsets")


_WV = """, wv as (select vec_id as track, list_transform(embedding, lambda x: x::double) as s from embeddings)"""


def _waves(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("track"), F.col("embedding").cast("array<double>").alias("samples"))


@query(_WV + " select track, k as frame, round(20 * log10(sqrt(list_sum(list_transform(s[k * 8 + 1:k * 8 + 16], lambda x: x * x)) / 16) + 1e-12), 6) as db from (select track, s, unnest(range(0, greatest(0, (len(s) - 16) // 8 + 1))) as k from wv)")
def moving_level_db(spark, sf_dir):
    return W.framed_db(_waves(spark, sf_dir), 16, 8).select("track", F.col("frame").cast("bigint").alias("frame"), _r("db"))


_CROSS = _WV + """, wp as (select track, i, s[i] as l, s[i + 1] as r from (select track, s, unnest(range(1, len(s) + 1)) as i from wv)),
 xs as (select track, (i - 1 + case when l = 0 then 0 else abs(l) / (abs(l) + abs(r)) end) / 64 as a, least(abs(l), coalesce(abs(r), abs(l))) as level from wp where l = 0 or l * r < 0),
 pt as (select track, k as point, (k * 9.7::double + track % 5) / 64 as t from wv, unnest(range(1, 6)) u(k))"""


def _targets(waves):
    k = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint"))).alias("point")
    return waves.select("track", k).select("track", "point", ((F.col("point") * 9.7 + F.col("track") % 5) / 64).alias("t"))


@query(_CROSS + " select pt.track, point, round(coalesce(arg_min(a, (abs(t - a), a)), any_value(t)), 6) as snapped from pt left join xs on xs.track = pt.track and abs(t - a) <= 0.03 group by pt.track, point")
def zero_cross_snap(spark, sf_dir):
    w = _waves(spark, sf_dir)
    return W.snap_to_crossing(_targets(w), w, 64.0, 0.03).select("track", "point", F.round("snapped", 6).alias("snapped"))


@query(_CROSS + " select pt.track, point, round(coalesce(arg_min(a, (level, a)), any_value(t)), 6) as snapped from pt left join xs on xs.track = pt.track and a >= t and a - t <= 0.1 group by pt.track, point")
def softest_zero_cross(spark, sf_dir):
    w = _waves(spark, sf_dir)
    return W.softest_crossing(_targets(w), w, 64.0, 0.1).select("track", "point", F.round("snapped", 6).alias("snapped"))


@query(_WV + """, ev as (select track, i - 1 as i, 20 * log10(sqrt(list_sum(list_transform(s[greatest(1, i - 2):least(len(s), i + 2)], lambda x: x * x)) / len(s[greatest(1, i - 2):least(len(s), i + 2)])) + 1e-12) as db from (select track, s, unnest(range(1, len(s) + 1)) as i from wv)),
 gp as (select track, k as point, k * 9 as pos from wv, unnest(range(1, 6)) u(k)),
 gm as (select g.track, point, pos, e.db as own, min(n.db) as low, arg_min(n.i, (n.db, n.i)) as best from gp g join ev e on e.track = g.track and e.i = pos join ev n on n.track = g.track and n.i >= pos and n.i < pos + 12 group by g.track, point, pos, e.db)
 select track, point, case when own - low >= 2 and low <= -8 then best else pos end as moved from gm""")
def quiet_guard(spark, sf_dir):
    w = _waves(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint"))).alias("point")
    p = w.select("track", k).withColumn("at", (F.col("point") * 9).cast("int"))
    return W.quiet_guard(p, w, 2, 12, 2.0, -8.0).select("track", "point", F.col("moved").cast("bigint").alias("moved"))


@query(_WV + """ select track, n as piece, b - a as samples, round(list_sum(s[a + 1:b]), 6) as total from wv, (select unnest([0, 1, 2]) as n, unnest([0, 20, 41]) as a, unnest([20, 41, 64]) as b)""")
def exact_split(spark, sf_dir):
    w = _waves(spark, sf_dir)
    cuts = w.select("track", F.explode(F.array(*(F.lit(x) for x in (0, 4, 20, 23, 41, 60)))).alias("at"))
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    return W.split_exactly(w, cuts, 8).select("track", F.col("piece").cast("bigint").alias("piece"), F.size("samples").cast("bigint").alias("samples"), F.round(total, 6).alias("total"))


@query(_WV + """ select track, round(list_sum([abs(s[i]) * least(1, (i - 1) / 10.0::double, (len(s) - i) / 10.0::double) for i in range(1, len(s) + 1)]), 6) as faded, round(list_sum([abs(greatest(-1, least(1, v * g))) for v in s]), 6) as normalised from (select *, case when m > 1e-10 then least(10, power(10, -6.0 / 20) / m) else 1 end as g from (select *, sqrt(list_sum([v * v for v in s]) / len(s)) as m from wv))""")
def fade_and_normalise(spark, sf_dir):
    w = _waves(spark, sf_dir)
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + F.abs(v))
    return W.faded(w, 10).select("track", F.round(total, 6).alias("faded")).join(W.normalised(w, -6.0).select("track", F.round(total, 6).alias("normalised")), "track")


@query(_WV + """, wq as (select *, sqrt(list_sum([v * v for v in s]) / len(s)) as rms, list_max([abs(v) for v in s]) as peak from wv)
 select track, round(rms, 6) as rms, round(peak, 6) as peak, round(20 * log10(peak / (rms + 1e-10)), 6) as crest_db, round(len([i for i in range(0, len(s) - 8, 4) if sqrt(list_sum([v * v for v in s[i + 1:i + 8]]) / 8) > 0.1 * rms]) / len(range(0, len(s) - 8, 4)), 6) as voiced, round(len([v for v in s if abs(v) < 0.05 * rms]) / len(s), 6) as silent from wq""")
def wave_quality(spark, sf_dir):
    return W.quality(_waves(spark, sf_dir), 8, 4).select("track", _r("rms"), _r("peak"), _r("crest_db"), _r("voiced"), _r("silent"))


@query(_WV + """, wb as (select track, k as point, k * 12 as pos, case when k % 2 = 0 then 'start' else 'end' end as edge, s from wv, unnest(range(0, 6)) u(k)),
 wr as (select track, point, case when edge = 'start' then s[greatest(0, pos - 6) + 1:pos] else s[pos + 1:least(len(s), pos + 6)] end as o, s from wb)
 select track, point, case when len(o) = 0 then 0.5 when list_sum([v * v for v in o]) / len(o) / (list_sum([v * v for v in s]) / len(s) + 1e-8) < 0.6 then 1.0 when list_sum([v * v for v in o]) / len(o) / (list_sum([v * v for v in s]) / len(s) + 1e-8) < 1.2 then 0.7 else 0.3 end::double as quality from wr""")
def boundary_quality(spark, sf_dir):
    w = _waves(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("point")
    p = w.select("track", k).withColumns({"at": (F.col("point") * 12).cast("int"), "edge": F.when(F.col("point") % 2 == 0, "start").otherwise("end")})
    return W.boundary_quality(p, w, 6, 0.6).select("track", "point", "quality")
