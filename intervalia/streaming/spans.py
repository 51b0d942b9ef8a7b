"""Spans merged across chunks over a stream: the open spans of a bucket of tracks are its state, and the watermark closes them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import merge

#: Where time 0 lies on the clock of the watermark, in seconds: behind 1970, before which Spark takes every row as late.
ORIGIN = 946_684_800
#: States that tracks are dealt to by hash. A call and a state cost the same for one track as for hundreds.
BUCKETS = 1024
#: Rows that are gathered before they are merged into what is open.
_ROWS = 1 << 16
_STATE = "tracks array<string>, starts array<double>, ends array<double>, counts array<bigint>"


def _chained(open_: pd.DataFrame, gap: float) -> pd.DataFrame:
    """Each track's maximal chains of spans whose next start is at most gap behind the end so far; chains of chains are chains."""
    if not len(open_):
        return open_
    open_ = open_.assign(code=pd.factorize(open_["track"], use_na_sentinel=False)[0]).sort_values(["code", "start", "end"], ignore_index=True)
    code, start = open_["code"].to_numpy(), open_["start"].to_numpy()
    so_far = open_.groupby("code")["end"].cummax().to_numpy()
    opens = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (start[1:] - so_far[:-1] > gap)]))
    chains = open_.iloc[opens][["track", "start"]]
    return chains.assign(end=np.maximum.reduceat(open_["end"].to_numpy(), opens), n=np.add.reduceat(open_["n"].to_numpy(), opens))


def merged_spans(spans: DataFrame, gap: float = 0.0, late: str = "1 hour", second: float = 1.0, buckets: int = BUCKETS) -> DataFrame:
    """track, start, end and n of spans (track, start, end) merged as `merge` does, on a stream or a table.

    On a stream a span may come up to late behind the latest start seen; later ones are dropped, as everywhere in Spark. A merged span leaves when the watermark has passed its end by gap,
    since nothing can join it then, so the state of a track is what lies between the watermark and now. The order of rows and micro-batches doesn't matter otherwise. A row without an end only
    moves the watermark: one that lies far enough behind closes all spans. second is the number of seconds in a unit of time; tracks are held as text, of any type that can be cast to text and
    back, in so many buckets (a checkpoint goes on with the number that it began with)."""
    if not spans.isStreaming:
        return merge(spans.where("start is not null and end is not null"), gap)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [], [])
        open_ = pd.DataFrame({"track": np.array(held[0], object), "start": np.array(held[1], float), "end": np.array(held[2], float), "n": np.array(held[3], np.int64)})
        if not state.hasTimedOut:
            parts, waiting = [open_], 0
            for frame in frames:
                frame = frame.loc[frame["end"].notna(), ["track", "start", "end"]]
                if len(frame):
                    parts.append(frame.astype({"track": object}).assign(n=np.int64(1)))
                    waiting += len(frame)
                if waiting > max(_ROWS, len(parts[0])):
                    parts, waiting = [_chained(pd.concat(parts), gap)], 0
            open_ = _chained(pd.concat([p for p in parts if len(p)]), gap) if waiting else parts[0]
        mark = state.getCurrentWatermarkMs()
        closed = (open_["end"] + gap < (mark / 1000 - ORIGIN) / second).to_numpy()
        left = open_[~closed]
        if len(left):
            state.update(tuple(left[c].tolist() for c in ("track", "start", "end", "n")))
            state.setTimeoutTimestamp(max(mark, int(np.ceil((left["end"].min() + gap) * second + ORIGIN) * 1000)) + 1)
        elif state.exists:
            state.remove()
        if closed.any():
            yield open_[closed]

    track = spans.schema["track"].dataType
    timed = spans.select(F.pmod(F.xxhash64(F.col("track").cast("string")), F.lit(buckets)).alias("bucket"), F.col("track").cast("string").alias("track"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.timestamp_seconds(F.col("start") * second + ORIGIN).alias("ts")).where("ts is not null").withWatermark("ts", late)
    merged = timed.groupBy("bucket").applyInPandasWithState(step, "track string, start double, end double, n bigint", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return merged.select(F.col("track").cast(track).alias("track"), "start", "end", "n")
