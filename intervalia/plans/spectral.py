"""Spectra of waves: a vector is a wave of 2000 samples a second; frames of 16 samples, 4 apart, in chunks of 24."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import pitch as P
from ..operators import spectral as X
from ..operators.finalise import wave_chunks
from . import events as E
from .events import _BASE, _r  # noqa: F401
from .signals import _WV, _waves

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = E.registrar(QUERIES, ORACLES)

FRAMES, SIZE, BANDS, KEPT = X.Frames(2000.0, 16, 4), 24, 6, 4

_MAG = _WV + """, fk as (select track, f, b, [case when f * 4 - 8 + k between 0 and len(s) - 1 then s[f * 4 - 8 + k + 1] else 0 end * (0.5 - 0.5 * cos(2 * pi() * k / 16)) for k in range(0, 16)] as x from (select track, s, f, unnest(range(0, 9)) as b from (select track, s, unnest(range(0, len(s) // 4 + 1)) as f from wv))),
 sp as (select track, f as frame, b, b * 125.0::double as hz, sqrt(power(list_sum([x[k + 1] * cos(2 * pi() * b * k / 16) for k in range(0, 16)]), 2) + power(list_sum([x[k + 1] * sin(2 * pi() * b * k / 16) for k in range(0, 16)]), 2)) as m from fk)"""


def _chunks(spark, sf_dir):
    return wave_chunks(_waves(spark, sf_dir), SIZE, FRAMES.size // 2, ("samples",))


@query(_MAG + " select track, frame, b as bin, round(m, 6) as magnitude from sp")
def spectra(spark, sf_dir):
    x = X.spectra(_chunks(spark, sf_dir), FRAMES, SIZE).select("track", "frame", F.posexplode("magnitude").alias("bin", "magnitude"))
    return x.select("track", "frame", F.col("bin").cast("bigint").alias("bin"), _r("magnitude"))


@query(_MAG + """, ct as (select *, sum(m * hz) over (partition by track, frame) / sum(m) over (partition by track, frame) as centroid, sum(m) over (partition by track, frame order by b) as upto, sum(m) over (partition by track, frame) as total from sp)
 select track, frame, round(any_value(centroid), 6) as centroid, round(sqrt(sum(m * power(hz - centroid, 2)) / sum(m)), 6) as bandwidth, min(hz) filter (upto >= 0.85::double * total) as rolloff, round(exp(avg(ln(greatest(m * m, 1e-10)))) / avg(greatest(m * m, 1e-10)), 6) as flatness from ct group by track, frame""")
def spectral_features(spark, sf_dir):
    return X.spectral_features(_chunks(spark, sf_dir), FRAMES, SIZE).select("track", "frame", _r("centroid"), _r("bandwidth"), "rolloff", _r("flatness"))


@query(_MAG + """, pk as (select *, sum(m) over w as total, b > 0 and b < 8 and m > lag(m) over (partition by track, frame order by b) and m > lead(m) over (partition by track, frame order by b) and m >= 0.1::double * max(m) over w as peak from sp window w as (partition by track, frame)),
 f0 as (select track, frame, any_value(total) as total, arg_max(b, (m, -b)) filter (peak and hz <= 500) as f0, list(m order by b) as ms, coalesce(sum(m) filter (hz >= 80 and hz <= 4000), 0) as vocal, coalesce(sum(m) filter (hz >= 200 and hz <= 1000), 0) as fundamental, coalesce(sum(m) filter (hz >= 1000 and hz <= 3000), 0) as formant from pk group by track, frame)
 select track, frame, round(vocal, 6) as vocal, round(fundamental, 6) as fundamental, round(formant, 6) as formant, round(fundamental / (total + 1e-8), 6) as clarity, round(case when f0 is null then 0 else list_sum([ms[least(8, f0 * h) + 1] for h in range(1, 6)]) / (total + 1e-8) end, 6) as harmonic from f0""")
def vocal_bands(spark, sf_dir):
    return X.vocal_features(_chunks(spark, sf_dir), FRAMES, SIZE).select("track", "frame", _r("vocal"), _r("fundamental"), _r("formant"), _r("clarity"), _r("harmonic"))


def _list(m: np.ndarray) -> str:
    return "[" + ", ".join("[" + ", ".join(repr(float(v)) for v in column) + "]" for column in m.T) + "]::double[][]"


@query(_MAG + f""", ml as (select track, frame, k, 10 * log10(greatest(1e-10, list_sum([power(ms[i + 1], 2) * w[k + 1][i + 1] for i in range(0, 9)]))) as db from (select track, frame, list(m order by b) as ms from sp group by track, frame), (select {_list(X.mel_basis(FRAMES, BANDS))} as w), unnest(range(0, {BANDS})) u(k)),
 cl as (select track, frame, list(greatest(db, top - 80) order by k) as db from (select *, max(db) over (partition by track) as top from ml) group by track, frame)
 select track, frame, c as coefficient, round(list_sum([db[k + 1] * cos(pi() / {BANDS} * (k + 0.5) * c) for k in range(0, {BANDS})]) * sqrt(case when c = 0 then 1 else 2 end / {BANDS}.0::double), 6) as mfcc from cl, unnest(range(0, {KEPT})) u(c)""")
def cepstra(spark, sf_dir):
    x = X.cepstra(_chunks(spark, sf_dir), FRAMES, SIZE, BANDS, KEPT).select("track", "frame", F.posexplode("mfcc").alias("coefficient", "mfcc"))
    return x.select("track", "frame", F.col("coefficient").cast("bigint").alias("coefficient"), _r("mfcc"))


@query(_MAG + """, cp as (select track, frame, (round(12 * log2(hz / 440) + 69)::bigint) % 12 as pitch, sum(m * m) as power from sp where hz >= 16 group by all)
 select track, frame, pitch, round(power / max(power) over (partition by track, frame), 6) as power from cp""")
def chroma(spark, sf_dir):
    return X.chroma(X.spectra(_chunks(spark, sf_dir), FRAMES, SIZE), FRAMES).select("track", "frame", F.col("pitch").cast("bigint").alias("pitch"), _r("power"))


LAGS = P.Lags(8000.0, 16, 4, 4, 12)
_N = LAGS.most - LAGS.least + 1


@query()
def pitch_contour(spark, sf_dir):
    chunks = wave_chunks(_waves(spark, sf_dir), SIZE, LAGS.halo, ("samples",))
    return P.pitch_contour(chunks, LAGS, SIZE).select("track", "frame", "lag", _r("hz"), "voiced")


ORACLES["pitch_contour"] = (
    (_BASE + _WV).replace("with e as", "with recursive e as", 1)
    + f""", df as (select track, f, tau, list_sum([power(s[f * 4 + j + 1] - s[f * 4 + j + tau + 1], 2) for j in range(0, 16)]) as d from (select track, s, f, unnest(range(1, 13)) as tau from (select track, s, unnest(range(0, (len(s) - 28) // 4 + 1)) as f from wv))),
 un as (select track, f, tau, case when sum(d) over w / tau > 1e-12 then d / (sum(d) over w / tau) else 1 end as c from df window w as (partition by track, f order by tau)),
 cs as (select track, f, list(c order by tau) filter (tau >= 4) as c from un group by track, f),
 st as (select track, f, c as best, []::bigint[][] as par from cs where f = 0
  union all select track, f + 1, [r[j].s + c[j] for j in range(1, {_N + 1})], par || [[x.k for x in r]] from (select st.track, st.f, par, cs.c, [list_reduce([struct_pack(s := best[k] + 0.5::double * abs(log2((k + 3) / (j + 3)::double)), k := k) for k in range(1, {_N + 1})], lambda a, x: case when x.s < a.s then x else a end) for j in range(1, {_N + 1})] as r from st join cs on cs.track = st.track and cs.f = st.f + 1)),
 en as (select track, max_by(best, f) as best, max_by(par, f) as par, max(f) as f from st group by track),
 wk as (select track, f, list_position(best, list_min(best))::bigint as j from en union all select wk.track, wk.f - 1, par[wk.f][j] from wk join en using (track) where wk.f > 0)
 select wk.track, wk.f as frame, j + 3 as lag, round(8000 / (j + 3)::double, 6) as hz, c[j] < 0.3 as voiced from wk join cs using (track, f)"""
)
