"""The finalising chain over waves: a vector is a second of a vocal wave at 64 samples, and the same backwards its mix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import finalise as Z
from . import events as E
from .events import _BASE, _r
from .signals import _WV, _waves

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = E.registrar(QUERIES, ORACLES)

MOVES = Z.Moves(rate=64.0, crossing=2, reach=12, window=5, guard_db=2.0, floor_db=-8.0)
GAP, EDGE, SIZE, POINTS = 0.1, 0.05, 16, 12


def _inputs(spark, sf_dir):
    w = _waves(spark, sf_dir).select("track", F.col("samples").alias("vocal"), F.reverse("samples").alias("mix"))
    k = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(POINTS).cast("bigint"))).alias("point")
    p = w.select("track", k).select("track", "point", ((F.col("point") * 4.9 + F.col("track") % 5) / 64).alias("t"), (((F.col("track") * 7 + F.col("point") * 13) % 17) / 17).alias("score"))
    return p, Z.wave_chunks(w, SIZE, MOVES.halo)


def _stage(name: str, of: str, wave: str, db: str) -> str:
    """CTEs of one crossing and one quieter place on a wave: from of.t to name.t."""
    m = MOVES
    return f""", {name}z as (select track, point, any_value(t) as t0, coalesce(case when any_value(idx) > 0 and any_value(idx) < 64 then arg_min(zero, (abs(zero - idx), pos)) filter (zero is not null) / 64 end, any_value(t)) as t from (
  select track, point, t, idx, pos, case when l = 0 then pos - 1 when r = 0 then pos when l * r < 0 then pos - 1 + abs(l) / (abs(l) + abs(r)) end::double as zero from (
   select track, point, t, idx, pos, {wave}[pos] as l, {wave}[pos + 1] as r from (select *, unnest(range(greatest(1, idx - {m.crossing}), least(63, idx + {m.crossing}) + 1)) as pos from (select q.track, point, q.t, round_even(q.t * 64, 0)::bigint as idx, {wave} from {of} q join wm using (track))))) group by track, point),
{name}f as (select z.track, point, any_value(z.t) as t, any_value(ix) as ix, min(d.{db}) as low, arg_min(d.i, (d.{db}, d.i)) as best, any_value(o.own) as own from (select *, greatest(0, least(63, round_even(t * 64, 0)::bigint)) as ix from {name}z) z join lv d on d.track = z.track and d.i >= ix and d.i < ix + {m.reach} join (select track, i, {db} as own from lv) o on o.track = z.track and o.i = ix group by z.track, point),
{name}w as (select track, point, t, greatest(0, round_even(t * 64, 0)::bigint) as ix, unnest(range(0, greatest(0, least(64, greatest(0, round_even(t * 64, 0)::bigint) + {m.reach}) - greatest(0, round_even(t * 64, 0)::bigint)))) as j, {wave} as wave from {name}z join wm using (track)),
{name}l as (select track, point, ix, j, 20 * log10(sqrt(list_sum([power(wave[least(ix + j + k, least(64, ix + {m.reach}) - 1) + 1], 2) for k in range(0, {m.window})]) / {m.window} + 1e-12) + 1e-12) as db from {name}w),
{name}s as (select track, point, any_value(ix) as ix, count(*) as n, min(db) as low, arg_min(j, (db, j)) as j, arg_min(db, j) as own from {name}l group by track, point),
{name} as (select f.track, f.point, case when f.own - f.low >= {m.guard_db} and f.low <= {m.floor_db} and best != f.ix then best / 64.0::double when s.n > {m.window} and s.own - s.low >= {m.guard_db} and s.low <= {m.floor_db} then least(63, s.ix + s.j + {m.window // 2}) / 64.0::double else f.t end as t from {name}f f left join {name}s s using (track, point))"""


def _level(wave: str) -> str:
    w = MOVES.window
    return f"20 * log10(sqrt(list_sum([power({wave}[k + 1], 2) for k in range(greatest(0, i - {w // 2}), least(64, i + {(w - 1) // 2} + 1))]) / {w} + 1e-12) + 1e-12)"


_CHAIN = (
    (_BASE + _WV).replace("with e as", "with recursive e as", 1)
    + f""", wm as (select track, s as vocal, list_reverse(s) as mix from wv), lv as (select track, i, {_level("vocal")} as dv, {_level("mix")} as dm from (select *, unnest(range(0, 64)) as i from wm)),
 raw as (select track, k as point, (k * 4.9::double + track % 5) / 64 as t, ((track * 7 + k * 13) % 17) / 17::double as score from wv, unnest(range(1, {POINTS + 1})) u(k)),
 od as (select *, row_number() over (partition by track order by score desc, t, point) as n from raw),
 nms as (select track, 0::bigint as n, []::double[] as kept, false as took from wv
  union all select track, od.n, case when ok then kept || [t] else kept end, ok from (select nms.track, nms.n + 1 as m, kept from nms) x join lateral (select od.n, od.t, len(list_filter(x.kept, lambda y: abs(y - od.t) < {GAP})) = 0 as ok from od where od.track = x.track and od.n = x.m) od on true),
 kp as (select track, point, t, score from nms join od using (track, n) where took)"""
    + _stage("g", "kp", "vocal", "dv")
    + _stage("m", "g", "mix", "dm")
    + f""", ad as (select kp.track, kp.point, kp.t as raw, score, g.t as guard, greatest(0, least(1, m.t)) as final from kp join g using (track, point) join m using (track, point)),
 ok as (select track, final as t from ad where final > {EDGE} and final < 1 - {EDGE}),
 gr as (select track, min(t) as t from ok group by track union all select gr.track, (select min(ok.t) from ok where ok.track = gr.track and ok.t - gr.t >= {GAP}) from gr where gr.t is not null),
 fc as (select track, t as cut from gr where t is not null)"""
)


@query()
def finalised_boundaries(spark, sf_dir):
    p, chunks = _inputs(spark, sf_dir)
    return Z.finalise(p, chunks, SIZE, MOVES, GAP, EDGE)[0].select("track", "sample", "score")


ORACLES["finalised_boundaries"] = _CHAIN + " select track, sample, 1.0::double as score from (select track, round_even(cut * 64, 0)::bigint as sample from fc union select track, unnest([0, 64]) from wv)"


@query()
def cut_adjustments(spark, sf_dir):
    p, chunks = _inputs(spark, sf_dir)
    return Z.finalise(p, chunks, SIZE, MOVES, GAP, EDGE)[1].select("track", *(_r(c) for c in ("cut", "raw", "guard", "final", "score", "guard_shift_ms", "final_shift_ms")))


ORACLES["cut_adjustments"] = _CHAIN + """ select track, round(cut, 6) as cut, round(raw, 6) as raw, round(guard, 6) as guard, round(final, 6) as final, round(score, 6) as score, round((guard - raw) * 1000, 6) as guard_shift_ms, round((final - raw) * 1000, 6) as final_shift_ms
 from (select fc.track, cut, unnest(arg_min(struct_pack(raw := raw, guard := guard, final := final, score := score), (abs(final - cut), final, raw))) from fc join ad using (track) group by fc.track, cut)"""


@query()
def suppressed_cuts(spark, sf_dir):
    p, chunks = _inputs(spark, sf_dir)
    return Z.finalise(p, chunks, SIZE, MOVES, GAP, EDGE)[2].select("track", "point", _r("t"), _r("score"))


ORACLES["suppressed_cuts"] = _CHAIN + " select track, point, round(t, 6) as t, round(score, 6) as score from raw anti join kp using (track, point)"
