"""Queries over events (a user's events are a track; times are hours since its first), embeddings, documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import clamp, decibels
from ..operators import candidates as C
from ..operators import intervals as I
from ..operators import series as S
from ..session import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def registrar(queries: dict, oracles: dict[str, str]):
    """A decorator that lists a query and, if given, its SQL (behind _BASE)."""

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = _BASE + sql
            return f

        return put

    return query


query = registrar(QUERIES, ORACLES)

_BASE = """with e as (select user_id as track, event_id, event_type, value, epoch_us(ts) as us from events),
p as (select track, event_id, event_type, value, (us - min(us) over (partition by track)) / 3600000000.0::double as t,
        row_number() over (partition by track order by us, event_id) as idx from e),
tracks as (select track, max(t) as duration from p group by track),
words as (select track, event_id, t as start, t + value / 100 as "end", value from p where event_type = 'view'),
regions as (select track, t as start, t + value / 50 as "end" from p where event_type = 'purchase'),
clicks as (select track, t as a, row_number() over (partition by track order by t, event_id) as n from p where event_type = 'click'),
cand as (select track, event_id as cand_id, t, least(value / 500, 1) as score,
           case event_type when 'view' then 'acoustic_pause' when 'click' then 'beat' when 'purchase' then 'sentence_end' when 'signup' then 'lyrics_gap' else 'breath' end as source from p),
rm as (select track, start, "end", max("end") over (partition by track order by start, "end" rows between unbounded preceding and 1 preceding) as m from regions),
rg as (select *, sum(case when m is null or start > m then 1 else 0 end) over (partition by track order by start, "end" rows unbounded preceding) as g from rm),
merged as (select track, min(start) as start, max("end") as "end", count(*) as n from rg group by track, g)
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, event_id, event_type, value, t and idx, the place in the track."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    e = e.select(F.col("user_id").alias("track"), "event_id", "event_type", "value", us.alias("us"))
    t = (F.col("us") - F.min("us").over(Window.partitionBy("track"))) / F.lit(3600000000.0)
    return e.select("track", "event_id", "event_type", "value", t.alias("t"), F.row_number().over(Window.partitionBy("track").orderBy("us", "event_id")).alias("idx"))


def _tracks(p: DataFrame) -> DataFrame:
    return p.groupBy("track").agg(F.max("t").alias("duration"))


def _words(p: DataFrame) -> DataFrame:
    return p.where("event_type = 'view'").select("track", "event_id", F.col("t").alias("start"), (F.col("t") + F.col("value") / 100).alias("end"), "value")


def _regions(p: DataFrame) -> DataFrame:
    return p.where("event_type = 'purchase'").select("track", F.col("t").alias("start"), (F.col("t") + F.col("value") / 50).alias("end"))


def _clicks(p: DataFrame) -> DataFrame:
    return p.where("event_type = 'click'").select("track", F.col("t").alias("a"), F.row_number().over(Window.partitionBy("track").orderBy("t", "event_id")).alias("n"))


def _candidates(p: DataFrame) -> DataFrame:
    source = F.create_map(*(F.lit(x) for pair in {"view": "acoustic_pause", "click": "beat", "purchase": "sentence_end", "signup": "lyrics_gap", "error": "breath"}.items() for x in pair))
    return p.select("track", F.col("event_id").alias("cand_id"), "t", F.least(F.col("value") / 500, F.lit(1.0)).alias("score"), source[F.col("event_type")].alias("source"))


_r = lambda c, n=6: F.round(c, n).alias(c if isinstance(c, str) else "x")


@query("""select t.track, round(coalesce(c.covered, 0) / t.duration, 6) as coverage from tracks t left join (
  with cl as (select r.track, greatest(0, start) as start, least("end", duration) as "end" from regions r join tracks using (track) where least("end", duration) > greatest(0, start)),
  m as (select *, max("end") over (partition by track order by start, "end" rows between unbounded preceding and 1 preceding) as m from cl),
  g as (select *, sum(case when m is null or start > m then 1 else 0 end) over (partition by track order by start, "end" rows unbounded preceding) as g from m)
  select track, sum(e - s) as covered from (select track, min(start) as s, max("end") as e from g group by track, g) group by track) c using (track)""")
def interval_coverage(spark, sf_dir):
    p = points(spark, sf_dir)
    return I.coverage(_regions(p), _tracks(p)).select("track", _r("coverage"))


@query("""select track, round(start, 6) as start, round("end", 6) as "end", n from merged""")
def interval_merge(spark, sf_dir):
    return I.merge(_regions(points(spark, sf_dir))).select("track", _r("start"), _r("end"), "n")


@query("""select track, round("end", 6) as start, round(nxt, 6) as "end" from (select track, "end", lead(start) over (partition by track order by start) as nxt from merged) where nxt is not null""")
def gap_complement(spark, sf_dir):
    return I.gaps(_regions(points(spark, sf_dir))).select("track", _r("start"), _r("end"))


_PADDED = """pw as (select w.track, greatest(0, x.s - {b}) as start, least(duration, x.e + {b}) as "end" from {src} join tracks using (track)),
 pf as (select * from pw where "end" > start),
 pm as (select *, max("end") over (partition by track order by start, "end" rows between unbounded preceding and 1 preceding) as m from pf),
 pg as (select *, sum(case when m is null or start > m then 1 else 0 end) over (partition by track order by start, "end" rows unbounded preceding) as g from pm)
 select track, round(min(start), 6) as start, round(max("end"), 6) as "end", count(*) as n from pg group by track, g"""


@query(", w as (select track, start as s, \"end\" as e from regions), " + _PADDED.format(b="0.5", src="(select track, s, e from w) w join lateral (select w.s as s, w.e as e) x on true"))
def pad_merge(spark, sf_dir):
    p = points(spark, sf_dir)
    return I.pad(_regions(p), _tracks(p), 0.5).select("track", _r("start"), _r("end"), "n")


@query(", w as (select track, unnest([start, \"end\"]) as s from regions), " + _PADDED.format(b="0.25", src="w join lateral (select w.s as s, w.s as e) x on true"))
def edge_windows(spark, sf_dir):
    p = points(spark, sf_dir)
    return I.edge_windows(_regions(p), _tracks(p), 0.25).select("track", _r("start"), _r("end"), "n")


@query("""select c.cand_id, count(w.start) as words, round(coalesce(max(case when w.start is null then 0.0 when w.value >= 425 then 1.0 else 0.3 end), 0)::double, 6) as penalty
 from cand c left join words w on c.track = w.track and w.start < c.t and c.t < w."end" group by c.cand_id""")
def point_in_word_penalty(spark, sf_dir):
    p = points(spark, sf_dir)
    found = I.points_in(_candidates(p), _words(p), how="left")
    penalty = F.max(F.when(F.col("start").isNull(), 0.0).when(F.col("value") >= 425, 1.0).otherwise(0.3))
    return found.groupBy("cand_id").agg(F.count("start").alias("words"), F.round(penalty, 6).alias("penalty"))


@query("""select cand_id, exists(select 1 from regions r where r.track = c.track and r.start < c.t and c.t < r."end") as inside from cand c""")
def point_in_region(spark, sf_dir):
    p = points(spark, sf_dir)
    inside = I.points_in(_candidates(p), I.merge(_regions(p)), how="left")
    return inside.select("cand_id", F.col("start").isNotNull().alias("inside")).groupBy("cand_id").agg(F.bool_or("inside").alias("inside"))


@query("""select c.cand_id, round(max(1 - abs(c.t - a) / 0.5), 6) as affinity, count(*) as anchors from cand c join clicks k on c.track = k.track and abs(c.t - a) <= 0.5 group by c.cand_id""")
def band_affinity(spark, sf_dir):
    p = points(spark, sf_dir)
    near = I.within(_candidates(p), _clicks(p).select("track", "a"), 0.5)
    return near.groupBy("cand_id").agg(F.round(F.max(1 - F.col("distance") / 0.5), 6).alias("affinity"), F.count("*").alias("anchors"))


@query("""select cand_id, round(min(abs(c.t - a)), 6) as distance from cand c join clicks k using (track) group by cand_id""")
def nearest_beat(spark, sf_dir):
    p = points(spark, sf_dir)
    return I.nearest(_candidates(p), _clicks(p)).where("nearest_a is not null").select("cand_id", _r("distance"))


@query("""select w.event_id, round(s.start, 6) as segment, round((least(w."end", s."end") - greatest(w.start, s.start)) / (w."end" - w.start), 6) as share
 from words w join merged s on w.track = s.track and (least(w."end", s."end") - greatest(w.start, s.start)) >= 0.5 * (w."end" - w.start) where w."end" > w.start and least(w."end", s."end") > greatest(w.start, s.start)""")
def overlap_words(spark, sf_dir):
    p = points(spark, sf_dir)
    both = I.overlapping(_words(p), I.merge(_regions(p)))
    length = F.col("end") - F.col("start")
    return both.where(F.col("overlap") >= 0.5 * length).select("event_id", F.round("r_start", 6).alias("segment"), F.round(F.col("overlap") / length, 6).alias("share"))


@query("""select track, round((pe + start) / 2, 6) as t, round(least(1, (start - pe) / 24), 6) as score from (
 select track, start, lag("end") over (partition by track order by start, event_id) as pe from words) where start - pe >= 12""")
def word_gap_candidates(spark, sf_dir):
    w = Window.partitionBy("track").orderBy("start", "event_id")
    x = _words(points(spark, sf_dir)).withColumn("pe", F.lag("end").over(w)).where(F.col("start") - F.col("pe") >= 12)
    return x.select("track", F.round((F.col("pe") + F.col("start")) / 2, 6).alias("t"), F.round(F.least(F.lit(1.0), (F.col("start") - F.col("pe")) / 24), 6).alias("score"))


@query("""select track, round(t, 6) as t, edge from (select track, start as t, 'start' as edge from regions union all select track, "end", 'end' from regions)""")
def region_edges(spark, sf_dir):
    edges = F.array(F.struct(F.col("start").alias("t"), F.lit("start").alias("edge")), F.struct(F.col("end").alias("t"), F.lit("end").alias("edge")))
    return _regions(points(spark, sf_dir)).select("track", F.explode(edges).alias("x")).select("track", F.round("x.t", 6).alias("t"), "x.edge")


_CLUSTERS = """, k as (select *, case when t - lag(t) over (partition by track order by t, source, cand_id) <= 1.0 then 0 else 1 end as o from cand),
 c as (select *, sum(o) over (partition by track order by t, source, cand_id rows unbounded preceding) as cluster from k)"""


@query(_CLUSTERS + " select track, cluster, count(*) as members, round(min(t), 6) as first_t, round(max(t), 6) as last_t from c group by track, cluster")
def gap_clusters(spark, sf_dir):
    c = S.clusters(_candidates(points(spark, sf_dir)), 1.0, ["source", "cand_id"])
    return c.groupBy("track", "cluster").agg(F.count("*").alias("members"), F.round(F.min("t"), 6).alias("first_t"), F.round(F.max("t"), 6).alias("last_t"))


@query(_CLUSTERS + """ select b.track, b.cluster, cand_id, round(t, 6) as t, round(score, 6) as score, source, sources, members from (
 select *, row_number() over (partition by track, cluster order by score desc, t, cand_id) as rn from c) b
 join (select track, cluster, string_agg(distinct source, ',' order by source) as sources, count(*) as members from c group by track, cluster) using (track, cluster) where rn = 1""")
def cluster_best(spark, sf_dir):
    c = S.clusters(_candidates(points(spark, sf_dir)), 1.0, ["source", "cand_id"])
    return C.fuse(c).select("track", "cluster", "cand_id", _r("t"), _r("score"), "source", "sources", "members")


@query("""select track, cand_id, round(score, 6) as score from (select *, row_number() over (partition by track, floor(t / 24) order by score desc, t, cand_id) as rn from cand) where rn <= 2""")
def per_bucket_topk(spark, sf_dir):
    return C.top_per_bucket(_candidates(points(spark, sf_dir)), 2, 24.0).select("track", "cand_id", _r("score"))


@query("""select cand_id, round(score - 0.25 * least(1, greatest(0, (value % 7) / 5)) - 0.15 * least(1, greatest(0, (value % 3) / 2)), 6) as value from cand join p on cand_id = event_id""")
def candidate_net_value(spark, sf_dir):
    p = points(spark, sf_dir)
    c = _candidates(p).join(p.select(F.col("event_id").alias("cand_id"), (F.col("value") % 7 / 5).alias("risk"), (F.col("value") % 3 / 2).alias("conflict")), "cand_id")
    return C.net_value(c).select("cand_id", _r("value"))


@query(""", f as (select *, value < 150 as flag from p), g as (select *, sum(case when flag = pf then 0 else 1 end) over (partition by track order by idx rows unbounded preceding) as run from (select *, lag(flag) over (partition by track order by idx) as pf from f))
 select track, round(min(t), 6) as start, round(max(t), 6) as "end", count(*) as n from g where flag group by track, run having count(*) >= 2""")
def threshold_runs(spark, sf_dir):
    return S.flagged_spans(points(spark, sf_dir), F.col("value") < 150, 2).select("track", _r("start"), _r("end"), "n")


@query(""", f as (select *, value < 250 as flag from p),
 g as (select *, sum(case when flag = pf then 0 else 1 end) over (partition by track order by idx rows unbounded preceding) as run from (select *, lag(flag) over (partition by track order by idx) as pf from f)),
 h as (select track, idx, flag or count(*) over (partition by track, run) <= 1 as flag from g),
 i as (select *, sum(case when flag = pf then 0 else 1 end) over (partition by track order by idx rows unbounded preceding) as run from (select *, lag(flag) over (partition by track order by idx) as pf from h))
 select track, idx, flag and count(*) over (partition by track, run) > 2 as flag from i""")
def run_morphology(spark, sf_dir):
    return S.morphology(points(spark, sf_dir).select("track", "idx", "value"), F.col("value") < 250, 1, 2).select("track", "idx", "flag")


@query("""select track, idx, round(value, 6) as value from (select *, lag(value) over w as l, lead(value) over w as r, quantile_cont(value, 0.35) over (partition by track) as q from p window w as (partition by track order by idx)) where value <= q and (value < l or value < r)""")
def percentile_valleys(spark, sf_dir):
    return S.valleys(points(spark, sf_dir).select("track", "idx", "value")).select("track", "idx", _r("value"))


@query("""select track, idx, round(sqrt(avg(value * value) over (partition by track order by idx rows between 4 preceding and 3 following)), 8) as rms from p""")
def rolling_rms(spark, sf_dir):
    return S.rolling_rms(points(spark, sf_dir).select("track", "idx", "value"), 4, 3).select("track", "idx", _r("rms", 8))


@query("""select vec_id, round(20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding)) + 1e-12), 4) as db from embeddings""")
def vector_level_db(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    square = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    return e.select("vec_id", F.round(decibels(F.sqrt(square / F.size("embedding"))), 4).alias("db"))


@query("""select track, bar, round(avg(value), 8) as energy, count(*) as frames from (
 select p.track, p.value, (select max((n - 1) // 4) from clicks k where k.track = p.track and k.a <= p.t) as bar from p) where bar is not null group by track, bar""")
def bar_energy(spark, sf_dir):
    p = points(spark, sf_dir)
    w = Window.partitionBy("track").orderBy("t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = p.select("track", "t", "value", F.lit(1).alias("_k"), F.lit(None).cast("bigint").alias("bar")).unionByName(
        _clicks(p).select("track", F.col("a").alias("t"), F.lit(None).cast("double").alias("value"), F.lit(0).alias("_k"), F.floor((F.col("n") - 1) / 4).alias("bar")))
    inside = both.withColumn("bar", F.max("bar").over(w)).where("_k = 1 and bar is not null")
    return inside.groupBy("track", "bar").agg(F.round(F.avg("value"), 8).alias("energy"), F.count("*").alias("frames"))


@query("""select track, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(avg(value), 8) as mean, round(max(value), 6) as top, count(*) as n from p group by track""")
def shift_stats(spark, sf_dir):
    q = lambda x, n: F.round(F.percentile("value", F.lit(x)), 6).alias(n)
    return points(spark, sf_dir).groupBy("track").agg(q(0.5, "p50"), q(0.95, "p95"), F.round(F.avg("value"), 8).alias("mean"), F.round(F.max("value"), 6).alias("top"), F.count("*").alias("n"))


@query("""select track, k as chunk, round(k * 90.0::double, 6) as start, round(least(k * 90.0 + 100, duration), 6) as "end", k > 0 as halo_left, k * 90.0 + 100 < duration as halo_right
 from (select track, duration, unnest(range(0, cast(greatest(ceil((duration - 100) / 90.0), 0) as bigint) + 1)) as k from tracks)""")
def chunk_plan(spark, sf_dir):
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil((F.col("duration") - 100) / 90.0), F.lit(0)).cast("bigint"))).alias("chunk")
    end = F.col("chunk") * 90.0 + 100
    return _tracks(points(spark, sf_dir)).select("track", "duration", k).select("track", "chunk", F.round(F.col("chunk") * 90.0, 6).alias("start"), F.round(F.least(end, F.col("duration")), 6).alias("end"), (F.col("chunk") > 0).alias("halo_left"), (end < F.col("duration")).alias("halo_right"))


@query(""" select track, frame, event_id from (select track, floor(t) as frame, event_id, row_number() over (partition by track, floor(t) order by t, event_id) as rn from p) where rn = 1""")
def frame_dedup(spark, sf_dir):
    w = Window.partitionBy("track", "frame").orderBy("t", "event_id")
    return points(spark, sf_dir).withColumn("frame", F.floor("t").cast("double")).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("track", "frame", "event_id")


@query()
def greedy_min_gap(spark, sf_dir):
    return S.greedy_gap(points(spark, sf_dir).select("track", "t"), 12.0).select("track", _r("t"))


ORACLES["greedy_min_gap"] = _BASE.replace("with e as", "with recursive e as", 1) + """, r as (select track, min(t) as t from p group by track
 union all select r.track, (select min(p.t) from p where p.track = r.track and p.t - r.t >= 12.0) from r where r.t is not null)
 select track, round(t, 6) as t from r where t is not null"""


@query()
def exponential_smoothing(spark, sf_dir):
    return S.smoothed(points(spark, sf_dir).select("track", "idx", "value"), 0.8).select("track", _r("smoothed"))


ORACLES["exponential_smoothing"] = _BASE + """select track, round(sum(0.2 * value * pow(0.8, m - idx)), 6) as smoothed from (select *, max(idx) over (partition by track) as m from p) group by track"""


@query()
def score_suppression(spark, sf_dir):
    return C.suppress(_candidates(points(spark, sf_dir)), 6.0).select("track", "cand_id", _r("t"), _r("score"))


@query()
def global_plan(spark, sf_dir):
    p = points(spark, sf_dir)
    best = C.fuse(S.clusters(_candidates(p), 1.0, ["source", "cand_id"]))
    return C.plan(C.top_per_bucket(best, 3, 24.0), _tracks(p), 12.0, 96.0, (24.0, 72.0)).select("track", "ord", _r("t"), "role")


@query("""select coalesce(lang, 'none') as lang, count(*) as n, round(avg(quality), 6) as pass_rate, case when count(*) < 10 then 'insufficient_data' when avg(quality) >= 0.8 then 'pass' else 'fail' end as gate
 from documents join labels using (doc_id) group by coalesce(lang, 'none')""")
def acceptance_gates(spark, sf_dir):
    both = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    rate = F.avg("quality")
    gate = F.when(F.count("*") < 10, "insufficient_data").when(rate >= 0.8, "pass").otherwise("fail")
    return both.groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"), F.round(rate, 6).alias("pass_rate"), gate.alias("gate"))


@query("""select conv_id, turn, round(least(1, 0.75::double + case when regexp_matches(trim(text), '[.!?。！？]$') then 0.1 else 0 end) * (case role when 'user' then 0.9 else 1.0 end)::double, 6) as score from conversations""")
def sentence_end_candidates(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    base = clamp(F.lit(0.75) + F.when(F.trim("text").rlike("[.!?。！？]$"), 0.1).otherwise(0.0))
    return c.select("conv_id", "turn", F.round(base * F.when(F.col("role") == "user", 0.9).otherwise(1.0), 6).alias("score"))


@query("""select track, count(*) as segments, round(median(d), 6) as median_s, round(avg(case when d between 5 and 48 then 1.0 else 0.0 end), 6) as pass_rate, round(max(d), 6) as longest
 from (select track, t - lag(t) over (partition by track order by t, event_id) as d from p) where d is not null group by track""")
def qa_report(spark, sf_dir):
    d = points(spark, sf_dir).select("track", (F.col("t") - F.lag("t").over(Window.partitionBy("track").orderBy("t", "event_id"))).alias("d")).where("d is not null")
    return d.groupBy("track").agg(F.count("*").alias("segments"), F.round(F.median("d"), 6).alias("median_s"), F.round(F.avg(F.when(F.col("d").between(5, 48), 1.0).otherwise(0.0)), 6).alias("pass_rate"), F.round(F.max("d"), 6).alias("longest"))


@query()
def reference_match(spark, sf_dir):
    p = points(spark, sf_dir)
    return C.match_one_to_one(_candidates(p).where("source = 'acoustic_pause'"), _clicks(p).select("track", F.col("a").alias("r")), 2.0).select("track", _r("t"), _r("r"))


@query()
def snap_to_beat(spark, sf_dir):
    p = points(spark, sf_dir)
    return C.snap_to_grid(_candidates(p).where("source = 'acoustic_pause'"), _clicks(p), 3.0, 6.0).select("track", _r("t"))


@query()
def segment_layout(spark, sf_dir):
    from ..operators import layout as L

    p = stored(points(spark, sf_dir), "segment_layout")
    best = C.fuse(S.clusters(_candidates(p), 1.0, ["source", "cand_id"]))
    cuts = C.plan(C.top_per_bucket(best, 3, 24.0), _tracks(p), 12.0, 96.0, (24.0, 72.0))
    labelled = L.label(L.from_cuts(cuts), p.select("track", "t", "value"), F.col("value") >= 250, 0.5)
    return L.refine(labelled, 8.0, 20.0, 80.0).select("track", "seg", _r("start"), _r("end"), "kind")


@query("""select track, idx - rn as region, min(idx) as first_idx, count(*) as n from (select track, idx, row_number() over (partition by track order by idx) as rn from
 (select *, quantile_cont(value, 0.6) over (partition by track) as q from p) where value >= q) group by track, idx - rn having count(*) >= 2""")
def high_energy_regions(spark, sf_dir):
    high = points(spark, sf_dir).withColumn("q", F.percentile("value", F.lit(0.6)).over(Window.partitionBy("track"))).where("value >= q")
    region = F.col("idx") - F.row_number().over(Window.partitionBy("track").orderBy("idx"))
    return high.withColumn("region", region).groupBy("track", "region").agg(F.min("idx").alias("first_idx"), F.count("*").alias("n")).where("n >= 2")


@query("""select track, round(sum(value * dt) / sum(dt), 6) as level, round(sum(case when value > 250 then dt else 0 end), 6) as active from
 (select track, value, lead(t) over (partition by track order by idx) - t as dt from p) where dt is not null group by track""")
def step_integral(spark, sf_dir):
    d = points(spark, sf_dir).withColumn("dt", F.lead("t").over(Window.partitionBy("track").orderBy("idx")) - F.col("t")).where("dt is not null")
    return d.groupBy("track").agg(F.round(F.sum(F.col("value") * F.col("dt")) / F.sum("dt"), 6).alias("level"), F.round(F.sum(F.when(F.col("value") > 250, F.col("dt")).otherwise(0.0)), 6).alias("active"))


@query("""select c.cand_id, round(least(1, greatest(0, w / q)), 8) as level from (select a.event_id as cand_id, a.track,
 avg(b.value) as w from p a join p b on a.track = b.track and abs(a.idx - b.idx) <= 3 group by a.event_id, a.track) c
 join (select track, quantile_cont(value, 0.99) as q from p group by track) using (track)""")
def local_level(spark, sf_dir):
    w = Window.partitionBy("track").orderBy("idx").rowsBetween(-3, 3)
    top = F.percentile("value", F.lit(0.99)).over(Window.partitionBy("track"))
    return points(spark, sf_dir).select(F.col("event_id").alias("cand_id"), F.round(clamp(F.avg("value").over(w) / top), 8).alias("level"))


@query("""select vec_id, i, round(i - 1 + l / (l - r), 6) as at from (select vec_id, i, embedding[i]::double as l, embedding[i + 1]::double as r from (select vec_id, embedding, unnest(range(1, len(embedding))) as i from embeddings)) where l * r < 0""")
def zero_crossings(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode(F.arrays_zip(F.slice("embedding", F.lit(1), F.size("embedding") - 1).alias("l"), F.slice("embedding", F.lit(2), F.size("embedding") - 1).alias("r"))))
    left, right = F.col("col.l").cast("double"), F.col("col.r").cast("double")
    return e.where(left * right < 0).select("vec_id", (F.col("pos") + 1).cast("bigint").alias("i"), F.round(F.col("pos") + left / (left - right), 6).alias("at"))


@query("""select track, round(0.5 * avg(value) / max(value) + 0.5 * (1 - least(1, stddev_pop(value) / avg(value))), 6) as blend,
 case when count(*) / max(t) < 0.08 then 'slow' when count(*) / max(t) < 0.1 then 'medium' else 'fast' end as style from p group by track""")
def style_estimate(spark, sf_dir):
    rate = F.count("*") / F.max("t")
    blend = 0.5 * F.avg("value") / F.max("value") + 0.5 * (1 - F.least(F.lit(1.0), F.stddev_pop("value") / F.avg("value")))
    return points(spark, sf_dir).groupBy("track").agg(F.round(blend, 6).alias("blend"), F.when(rate < 0.08, "slow").when(rate < 0.1, "medium").otherwise("fast").alias("style"))
