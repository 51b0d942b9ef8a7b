"""Queries over the features, pools and plans of cut candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boundaries as B
from ..operators import candidates as C
from ..operators import series as S
from ..session import stored
from . import events as E
from .events import _BASE, _r, points

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = E.registrar(QUERIES, ORACLES)

#: Confidence of a word or region; every tenth event has none.
_CONF = "case when event_id % 10 = 0 then null else least(value / 500, 1) end"
_MORE = f""", cw as (select track, event_id, t as start, t + value / 100 as "end", {_CONF} as confidence from p where event_type = 'view'),
cr as (select track, event_id, t as start, t + value / 50 as "end", {_CONF} as confidence from p where event_type = 'purchase'),
valley as (select track, t as a from p where event_type = 'error'),
"""


def _confidence():
    return F.when(F.col("event_id") % 10 == 0, None).otherwise(F.least(F.col("value") / 500, F.lit(1.0))).alias("confidence")


def _spans(p, kind: str, width: float):
    return p.where(F.col("event_type") == kind).select("track", "event_id", F.col("t").alias("start"), (F.col("t") + F.col("value") / width).alias("end"), _confidence())


def _parts(p):
    return _spans(p, "view", 100.0), _spans(p, "purchase", 50.0), p.where("event_type = 'error'").select("track", F.col("t").alias("a"))


_PEN = "case when confidence is null then 0.5 when confidence >= 0.85 then 1.0 else 0.3 end::double"
_WORD = f"""fw as (select cand_id, arg_min({_PEN} * least(1, greatest(0, least(c.t - start, "end" - c.t) / 0.25)), (start, "end")) as v from cand c join cw on c.track = cw.track and start < c.t and c.t < "end" group by cand_id)"""
_REGION = f"""fr as (select cand_id, arg_min({_PEN}, (start, "end")) as v from cand c join cr on c.track = cr.track and start < c.t and c.t < "end" group by cand_id)"""
_GAP = """gp as (select track, n, "end" as a, nx as b from (select track, "end", row_number() over w as n, lead(start) over w as nx from cw window w as (partition by track order by start, "end")) where nx >= "end"),
fg as (select cand_id, arg_min(least(1, (b - a) / 24), n) as v from cand c join gp on c.track = gp.track and a <= c.t and c.t <= b group by cand_id)"""
_END = """fe as (select cand_id, max(coalesce(confidence, 1.0) * (1 - abs(c.t - "end") / 2.0)) as v from cand c join cr on c.track = cr.track and abs(c.t - "end") <= 2.0 group by cand_id)"""
_BEAT = """fb as (select cand_id, max(1 - abs(c.t - a) / 1.5) as v from cand c join clicks k on c.track = k.track and abs(c.t - a) <= 1.5 group by cand_id)"""
_VALLEY = """fv as (select cand_id, max(1 - abs(c.t - a) / 1.5) as v from cand c join valley k on c.track = k.track and abs(c.t - a) <= 1.5 group by cand_id)"""
_CONFLICT = """fc as (select cand_id, least(1, min(abs(c.t - a)) / 1.5) as v from cand c join clicks k using (track) group by cand_id)"""


def _plain(found, name: str):
    return found.select("cand_id", F.round("value", 6).alias(name))


@query(_MORE + _WORD + " select cand_id, round(v, 6) as penalty from fw")
def word_edge_penalty(spark, sf_dir):
    p = points(spark, sf_dir)
    return _plain(B.inside_word(E._candidates(p), _parts(p)[0], 0.25), "penalty")


@query(_MORE + _REGION + " select cand_id, round(v, 6) as penalty from fr")
def region_penalty(spark, sf_dir):
    p = points(spark, sf_dir)
    return _plain(B.inside_region(E._candidates(p), _parts(p)[1]), "penalty")


@query(_MORE + _GAP + " select cand_id, round(v, 6) as gap from fg")
def word_gap_score(spark, sf_dir):
    p = points(spark, sf_dir)
    return _plain(B.word_gap(E._candidates(p), _parts(p)[0], 24.0), "gap")


@query(_MORE + _END + " select cand_id, round(v, 6) as score from fe")
def sentence_end_affinity(spark, sf_dir):
    p = points(spark, sf_dir)
    return _plain(B.sentence_end(E._candidates(p), _parts(p)[1].select("track", F.col("end").alias("a"), "confidence"), 2.0), "score")


@query(_MORE + _CONFLICT + " select cand_id, round(v, 6) as conflict from fc")
def beat_conflict(spark, sf_dir):
    p = points(spark, sf_dir)
    return _plain(B.conflict(E._candidates(p), E._clicks(p), 1.5), "conflict")


_NAMES = ["inside_word_penalty", "singing_penalty", "asr_gap", "sentence_end", "beat_affinity", "mdd_affinity", "beat_conflict"]


def _features(p):
    c, (words, regions, valleys) = E._candidates(p), _parts(p)
    ends = regions.select("track", F.col("end").alias("a"), "confidence")
    lists = [B.inside_word(c, words, 0.25), B.inside_region(c, regions), B.word_gap(c, words, 24.0), B.sentence_end(c, ends, 2.0), B.affinity("beat_affinity", c, E._clicks(p), 1.5), B.affinity("mdd_affinity", c, valleys, 1.5), B.conflict(c, E._clicks(p), 1.5)]
    own = lambda s: F.when(F.col("source") == s, F.col("score")).otherwise(0.0)
    return B.gather(c, lists, _NAMES).withColumns({"acoustic_pause": own("acoustic_pause"), "breath": own("breath")})


_ALL = _MORE + ",\n".join([_WORD, _REGION, _GAP, _END, _BEAT, _VALLEY, _CONFLICT]) + """,
feat as (select c.*, coalesce(fw.v, 0) as inside_word_penalty, coalesce(fr.v, 0) as singing_penalty, coalesce(fg.v, 0) as asr_gap, coalesce(fe.v, 0) as sentence_end, coalesce(fb.v, 0) as beat_affinity,
  coalesce(fv.v, 0) as mdd_affinity, coalesce(fc.v, 0) as beat_conflict, case when source = 'acoustic_pause' then score else 0 end as acoustic_pause, case when source = 'breath' then score else 0 end as breath
  from cand c left join fw using (cand_id) left join fr using (cand_id) left join fg using (cand_id) left join fe using (cand_id) left join fb using (cand_id) left join fv using (cand_id) left join fc using (cand_id)),
scored as (select cand_id, track, t, source, least(1, greatest(0, 0.35 * acoustic_pause + 0.20 * asr_gap + 0.15 * sentence_end + 0.08 * beat_affinity + 0.10 * mdd_affinity + 0.12 * breath - 0.80 * inside_word_penalty - 0.50 * singing_penalty)) as score, beat_conflict as conflict from feat)
"""


@query(_ALL + " select cand_id, " + ", ".join(f"round({n}::double, 6) as {n}" for n in [*_NAMES, "acoustic_pause", "breath"]) + " from feat")
def boundary_features(spark, sf_dir):
    return _features(points(spark, sf_dir)).select("cand_id", *(_r(n) for n in [*_NAMES, "acoustic_pause", "breath"]))


@query(_ALL + " select cand_id, round(score::double, 6) as score from scored")
def boundary_score(spark, sf_dir):
    return B.linear_score(_features(points(spark, sf_dir))).select("cand_id", _r("score"))


_LYRICS = _MORE + """ly as (select track, ("end" + nx) / 2 as t, least(1, (nx - "end") / 24) as score, 'lyrics_gap' as source from (select *, lead(start) over (partition by track order by start, "end") as nx from cw) where nx - "end" >= 12
 union all select track, "end", least(1, (case when event_id % 3 = 0 then 0.85 else 0.75 end)::double * coalesce(confidence, 1.0)), 'sentence_end' from cr
 union all select track, unnest([start, "end"]), 0.45::double * coalesce(confidence, 1.0), 'mvad' from cr)"""


def _lyrics(p):
    words, regions, _ = _parts(p)
    text = F.when(F.col("event_id") % 3 == 0, F.lit("done.")).otherwise(F.lit("and"))
    return B.lyrics_candidates(words, regions.withColumn("text", text), regions, 12.0, 24.0)


@query(_LYRICS + " select track, round(t, 6) as t, round(score, 6) as score, source from ly")
def lyrics_candidates(spark, sf_dir):
    return _lyrics(points(spark, sf_dir)).select("track", _r("t"), _r("score"), "source")


@query(_LYRICS + """ select track, source, count(*) as n, round(min(t), 6) as first_t, round(max(score), 6) as best from (select track, t, score, source from cand where source = 'acoustic_pause' union all select * from ly union all select track, a, 0.3, 'beat' from clicks) group by track, source""")
def candidate_pool(spark, sf_dir):
    p = points(spark, sf_dir)
    acoustic = E._candidates(p).where("source = 'acoustic_pause'").select("track", "t", "score", "source")
    beats = E._clicks(p).select("track", F.col("a").alias("t"), F.lit(0.3).alias("score"), F.lit("beat").alias("source"))
    pooled = B.pool(acoustic, _lyrics(p), beats)
    return pooled.groupBy("track", "source").agg(F.count("*").alias("n"), F.round(F.min("t"), 6).alias("first_t"), F.round(F.max("score"), 6).alias("best"))


@query(E._CLUSTERS + """, ps as (select track, cluster, source, min((t, source, cand_id)) as f, max(score) as top from c group by track, cluster, source),
 s as (select track, cluster, string_agg(source, ',' order by f) as sources, string_agg(source || '=' || printf('%.6f', top), ',' order by f) as source_scores from ps group by track, cluster),
 m as (select track, cluster, string_agg(cand_id::varchar, ',' order by t, source, cand_id) as members from c group by track, cluster)
 select b.track, b.cluster, cand_id, source, sources, source_scores, members from (select *, row_number() over (partition by track, cluster order by score desc, t, cand_id) as rn from c) b join s using (track, cluster) join m using (track, cluster) where rn = 1""")
def cluster_representatives(spark, sf_dir):
    x = B.representatives(S.clusters(E._candidates(points(spark, sf_dir)), 1.0, ["source", "cand_id"]))
    scores = F.array_join(F.transform(F.map_entries("source_scores"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"]))), ",")
    return x.select("track", "cluster", "cand_id", "source", F.array_join("sources", ",").alias("sources"), scores.alias("source_scores"), F.array_join(F.transform("members", lambda m: m["cand_id"].cast("string")), ",").alias("members"))


# The planner: values are net of conflict, a bucket of 24 hours keeps its best three.
_PRUNED = _ALL + """, val as (select s.*, score - 0.15 * conflict as value, duration from scored s join tracks using (track) where t > 0 and t < duration),
kept as (select * from (select *, row_number() over (partition by track, floor(t / 24) order by value desc, t, cand_id) as rn from val) where rn <= 3)"""


def _plan_parts(p, once: str | None = None):
    """Candidates with scores, and those that the planner gets; with once, scores are a work table of that name for queries that read both."""
    scored = B.linear_score(_features(p)).select("track", "cand_id", "t", "score", "source", F.col("beat_conflict").alias("conflict"), F.lit(0.0).alias("risk"))
    scored = stored(scored, once) if once else scored
    return scored, C.prune(C.net_value(scored), E._tracks(p), 3, 24.0)


@query(_PRUNED + " select track, cand_id, round(value::double, 6) as value from kept")
def pruned_candidates(spark, sf_dir):
    return _plan_parts(points(spark, sf_dir))[1].select("track", "cand_id", _r("value"))


_NODES = _PRUNED + """, nd as (select d.track, duration, [0.0::double] || coalesce(list(t order by t, cand_id) filter (t is not null), []) || [duration] as ts, [0.0::double] || coalesce(list(value::double order by t, cand_id) filter (t is not null), []) || [0.0::double] as vs,
  [-1::bigint] || coalesce(list(cand_id order by t, cand_id) filter (t is not null), []) || [-2::bigint] as ids from tracks d left join (select track, t, value, cand_id from kept) k using (track) group by d.track, duration),
st as (select track, 1 as i, [0.0::double] as best, [0] as par from nd
 union all select track, i + 1, best || [coalesce(b.s, -1e18)], par || [coalesce(b.j, 0)] from (
  select st.track, i, best, par, list_reduce([struct_pack(s := -1e17, j := 0)] || [struct_pack(s := best[j] + vs[i + 1] + case when ts[i + 1] - ts[j] between 24 and 72 then 0.1::double when ts[i + 1] - ts[j] < 24 then -0.05::double * (24 - (ts[i + 1] - ts[j])) / 72 else -0.05::double * (ts[i + 1] - ts[j] - 72) / 72 end, j := j)
    for j in range(1, i + 1) if (duration <= 12 or (ts[i + 1] - ts[j] >= 12 and ts[i + 1] - ts[j] <= 96)) and best[j] > -1e16], lambda a, x: case when x.s > a.s then x else a end) as b from st join nd using (track) where i < len(ts))),
fin as (select track, best, par from st join nd using (track) where i = len(ts)),
walk as (select track, len(par) as pos, 0 as k from fin where best[len(best)] > -1e16 union all select track, par[pos], k + 1 from walk join fin using (track) where par[pos] > 0),
path as (select track, pos from walk),
ns as (select track, duration, case when duration / greatest(1, ceil(duration / 96)) < 12 and ceil(duration / 96) > 1 then greatest(1, floor(duration / 12)) else greatest(1, ceil(duration / 96)) end::bigint as n from tracks where track not in (select track from walk)),
plan as (select track, row_number() over (partition by track order by pos) - 1 as ord, ts[pos] as t, ids[pos] as cand_id, case when pos = 1 or pos = len(ts) then 'edge' else 'cut' end as role from path join nd using (track)
 union all select track, k, case when k = n then duration else round(k * duration / n, 9) end, case when k = 0 then -1 when k = n then -2 else -3 end, case when k = 0 or k = n then 'edge' else 'rescue' end from (select *, unnest(range(0, n + 1)) as k from ns))"""
_NODES = _NODES.replace("with e as", "with recursive e as", 1)


@query()
def optimal_plan(spark, sf_dir):
    p = points(spark, sf_dir)
    return C.optimal(_plan_parts(p)[1], E._tracks(p), 12.0, 96.0, (24.0, 72.0), 0.05).select("track", F.col("ord").cast("bigint").alias("ord"), _r("t"), "role")


ORACLES["optimal_plan"] = (_BASE + _NODES).replace("with e as", "with recursive e as", 1) + " select track, ord, round(t, 6) as t, role from plan"


@query()
def suppressed_candidates(spark, sf_dir):
    p = points(spark, sf_dir)
    scored, pruned = _plan_parts(p)
    return B.suppressed(scored, C.optimal(pruned, E._tracks(p), 12.0, 96.0, (24.0, 72.0), 0.05).where("role = 'cut'")).select("track", "cand_id", _r("t"), _r("score"))


ORACLES["suppressed_candidates"] = (_BASE + _NODES).replace("with e as", "with recursive e as", 1) + " select track, cand_id, round(t, 6) as t, round(score::double, 6) as score from scored where cand_id not in (select cand_id from plan where role = 'cut')"


@query()
def plan_cut_points(spark, sf_dir):
    p = points(spark, sf_dir)
    scored, pruned = _plan_parts(p)
    cuts = C.optimal(pruned, E._tracks(p), 12.0, 96.0, (24.0, 72.0), 0.05).where("role = 'cut'").select("cand_id")
    return scored.join(cuts, "cand_id").select("track", _r("t"), _r("score"), F.col("source").alias("kind"))


ORACLES["plan_cut_points"] = (_BASE + _NODES).replace("with e as", "with recursive e as", 1) + " select track, round(s.t, 6) as t, round(score::double, 6) as score, source as kind from scored s join (select cand_id from plan where role = 'cut') using (cand_id)"


@query()
def score_suppression_windowed(spark, sf_dir):
    return C.suppress(E._candidates(points(spark, sf_dir)), 3.0, topk=20, per_window=2, window=48.0).select("track", "cand_id", _r("t"), _r("score"))


_NMS = _BASE.replace("with e as", "with recursive e as", 1) + """, od as (select *, row_number() over (partition by track order by score desc, t, cand_id) as n from cand),
nms as (select track, 0::bigint as n, []::double[] as kept, false as took from tracks
 union all select track, od.n, case when ok then kept || [t] else kept end, ok from (select nms.track, nms.n + 1 as m, kept from nms) x join lateral (select od.n, od.t, len(list_filter(x.kept, lambda y: abs(y - od.t) < {gap})) = 0 {more} as ok from od where od.track = x.track and od.n = x.m) od on true)
 select track, cand_id, round(t, 6) as t, round(score, 6) as score from nms join od using (track, n) where took"""
ORACLES["score_suppression_windowed"] = _NMS.format(gap="3.0", more="and len(list_filter(x.kept, lambda y: floor(y / 48) = floor(od.t / 48))) < 2 and len(x.kept) < 20")
ORACLES["score_suppression"] = _NMS.format(gap="6.0", more="")

ORACLES["reference_match"] = _BASE.replace("with e as", "with recursive e as", 1) + """, pd as (select track, t, row_number() over (partition by track order by t) as n from cand where source = 'acoustic_pause'),
rf as (select track, list(a order by a) as refs from clicks group by track),
mt as (select track, 0::bigint as n, []::bigint[] as used, null::bigint as hit from rf
 union all select x.track, y.n, case when y.b is null then used else used || [y.b] end, y.b from (select mt.track, mt.n + 1 as m, used, refs from mt join rf using (track)) x
  join lateral (select pd.n, list_reduce([struct_pack(d := 2.0::double, i := null::bigint)] || [struct_pack(d := abs(x.refs[i] - pd.t), i := i) for i in range(1, len(x.refs) + 1) if abs(x.refs[i] - pd.t) <= 2.0 and not list_contains(x.used, i)], lambda a, z: case when z.d <= a.d then z else a end).i as b from pd where pd.track = x.track and pd.n = x.m) y on true)
 select track, round(t, 6) as t, round(refs[hit], 6) as r from mt join pd using (track, n) join rf using (track) where hit is not null"""

ORACLES["snap_to_beat"] = _BASE.replace("with e as", "with recursive e as", 1) + """, nb as (select cand_id, c.track, c.t, arg_min(a, (abs(c.t - a), a)) as b from cand c left join clicks k using (track) where source = 'acoustic_pause' group by all),
mv as (select track, case when abs(t - b) <= 3.0 then b else t end as t from nb),
r as (select track, min(t) as t from mv group by track union all select r.track, (select min(mv.t) from mv where mv.track = r.track and mv.t - r.t >= 6.0) from r where r.t is not null)
 select track, round(t, 6) as t from r where t is not null"""


@query()
def full_layout(spark, sf_dir):
    """Segments of the optimal plan, labelled by their levels, laid out in seven steps; tests hold its golden cases and compare it with plain loops."""
    from ..operators import layout as L

    p = stored(points(spark, sf_dir), "full_layout")
    scored, pruned = _plan_parts(p, "full_layout")
    plan = stored(C.optimal(pruned, E._tracks(p), 12.0, 96.0, (24.0, 72.0), 0.05), "full_layout")
    labelled = L.label(L.from_cuts(plan), p.select("track", "t", "value"), F.col("value") >= 250, 0.5)
    words, regions, _ = _parts(p)
    left = B.suppressed(scored, plan.where("role = 'cut'"))
    limits = L.Limits(micro=20.0, soft_min=30.0, soft_max=60.0, gap=6.0, snap=3.0)
    phrases = regions.select("track", F.col("end").alias("a"))
    return L.lay_out(labelled, limits, left, p.select("track", "t", "value"), phrases, words, E._clicks(p)).select("track", F.col("seg").cast("bigint").alias("seg"), _r("start"), _r("end"), "kind")


@query()
def phrase_summary(spark, sf_dir):
    """Phrase boundaries from candidates to plan: how many of a track's candidates there were, went into the plan and were chosen, and by which planner."""
    p = points(spark, sf_dir)
    scored, pruned = _plan_parts(p)
    plan = C.optimal(pruned, E._tracks(p), 12.0, 96.0, (24.0, 72.0), 0.05)
    n = lambda df, name: df.groupBy("track").agg(F.count("*").alias(name))
    chosen = plan.groupBy("track").agg(F.count(F.when(F.col("role") == "cut", 1)).alias("selected"), F.count(F.when(F.col("role") == "rescue", 1)).alias("rescued"))
    x = E._tracks(p).join(n(scored, "candidates"), "track", "left").join(n(pruned, "planned"), "track", "left").join(chosen, "track", "left").na.fill(0)
    planner = F.when(F.col("rescued") > 0, "rescue").otherwise("dynamic_programming")
    return x.select("track", "candidates", "planned", "selected", planner.alias("planner"))


ORACLES["phrase_summary"] = (_BASE + _NODES).replace("with e as", "with recursive e as", 1) + """ select track, (select count(*) from scored s where s.track = t.track) as candidates, (select count(*) from kept k where k.track = t.track) as planned,
 count(*) filter (role = 'cut') as selected, case when count(*) filter (role = 'rescue') > 0 then 'rescue' else 'dynamic_programming' end as planner from tracks t join plan using (track) group by track"""
