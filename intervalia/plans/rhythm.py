"""Tempo and beats of the events' levels: a track's events in order are frames of 50 ms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rhythm as R
from . import events as E
from .events import _BASE, _r, points

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = E.registrar(QUERIES, ORACLES)

HOP, LAGS = 0.05, (6, 40)

_TEMPO = f""", os as (select track, idx - 1 as i, coalesce(greatest(0, value - lag(value) over (partition by track order by idx)), 0) as o from p),
lp as (select a.track, b.i - a.i as lag, sum(a.o * b.o) as product from os a join os b on a.track = b.track and b.i - a.i between {LAGS[0]} and {LAGS[1]} group by a.track, b.i - a.i),
lw as (select *, 60 / (lag * {HOP}::double) as bpm, product * exp(-0.5 * power(log2(60 / (lag * {HOP}::double)) - log2(120), 2)) as s from lp),
tp as (select track, arg_max(lag, (s, -lag)) as period, arg_max(bpm, (s, -lag)) as bpm, max(s) as strength from lw where s > 0 group by track)"""


def _onsets(spark, sf_dir):
    return R.onset_strength(points(spark, sf_dir).select("track", "idx", "value"))


def _tempo(onsets):
    return R.tempo(R.lag_products(onsets, *LAGS), HOP)


@query(_TEMPO + " select track, period, round(bpm, 6) as bpm, round(strength, 4) as strength from tp")
def tempo_estimate(spark, sf_dir):
    return _tempo(_onsets(spark, sf_dir)).select("track", "period", _r("bpm"), _r("strength", 4))


_BEATS = _TEMPO + """, nd as (select track, period, list(o / d order by i) as v from (select track, i, o, stddev_samp(o) over (partition by track) as d from os) join tp using (track) where d > 0 group by track, period),
st as (select track, 0 as i, []::double[] as c, []::bigint[] as par from nd
 union all select track, i + 1, c || [v[i + 1] + greatest(0, coalesce(b.s, 0))], par || [case when b.s > 0 then b.j else 0 end] from (
  select st.track, i, c, par, v, list_reduce([struct_pack(s := -1e17::double, j := 0::bigint)] || [struct_pack(s := c[j] - 100 * power(ln((i + 1 - j) / period::double), 2), j := j) for j in range(greatest(1, i + 1 - 2 * period), i + 2 - (period + 1) // 2)], lambda a, x: case when x.s > a.s then x else a end) as b from st join nd using (track) where i < len(v))),
fin as (select st.track, c, par, period, greatest(1, len(c) - period + 1) as lo from st join nd using (track) where i = len(v)),
tail as (select track, list_reduce([struct_pack(s := c[j], j := j) for j in range(lo, len(c) + 1)], lambda a, x: case when x.s > a.s then x else a end).j as pos from fin),
walk as (select track, pos from tail union all select walk.track, par[pos] from walk join fin using (track) where par[pos] > 0)"""


@query()
def beat_track(spark, sf_dir):
    o = _onsets(spark, sf_dir)
    return R.beats(o, _tempo(o)).select("track", "idx")


ORACLES["beat_track"] = (_BASE + _BEATS).replace("with e as", "with recursive e as", 1) + " select track, pos - 1 as idx from walk"


@query()
def tempo_features(spark, sf_dir):
    o = _onsets(spark, sf_dir)
    t = _tempo(o)
    return R.tempo_features(R.beats(o, t).select("track", (F.col("idx") * HOP).alias("t")), t).select("track", _r("bpm"), _r("stability"), _r("variance"), "category")


ORACLES["tempo_features"] = (_BASE + _BEATS).replace("with e as", "with recursive e as", 1) + f""", bd as (select track, (pos - lag(pos) over (partition by track order by pos)) * {HOP}::double as step from walk),
bv as (select track, count(*) as n, stddev_pop(step) / avg(step) as v from bd group by track)
 select track, round(bpm, 6) as bpm, round(case when n >= 3 then 1 - least(1, v) else 0.5::double end, 6) as stability, round(case when n >= 3 then least(1, v) else 0.1::double end, 6) as variance,
 case when bpm < 50 then 'very_slow' when bpm < 80 then 'slow' when bpm < 120 then 'medium' when bpm < 160 then 'fast' when bpm < 200 then 'very_fast' else 'extreme_fast' end as category from tp left join bv using (track)"""
