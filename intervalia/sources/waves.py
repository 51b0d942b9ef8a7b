"""Waves as files: a data source "wave" that reads and writes RIFF files of PCM or float samples as rows of chunks.

Reading. Files are split by bytes; a task reads a file's header itself, and of its samples the chunks that begin in its range, so a long file is many tasks and the driver
sees names and sizes only. Rows: path (below the folder), chunk, offset (frames before it), rate, channels, bits, length (frames of the file), samples, error. A file without frames is one row
with no samples. A data part that ends early counts as far as its frames are whole.
Options: chunkFrames; splitBytes; channels "mono" (the mean, default) or "keep" (interleaved); mode "FAILFAST" (default) or "PERMISSIVE" (a damaged file becomes a row with its error).

Writing. Rows path, chunk, length, samples, a file's chunks in order and in one task (`write_waves` deals and sorts them). A task streams chunks to numbered files in a staging folder, so it holds one batch, and lists their names
there; the driver gets the folders only and moves their files side by side when all tasks are done, and a failed job leaves none. The format ends at 4 GB a file; longer waves raise an error. Samples over 1 in size are clipped, null and NaN are 0.
Options: rate; bits 16, 24 or 32; channels (samples are interleaved)."""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "path string, chunk bigint, offset bigint, rate int, channels int, bits int, length bigint, samples array<double>, error string"
_ARROW = pa.schema(
    [("path", pa.string()), ("chunk", pa.int64()), ("offset", pa.int64()), ("rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("length", pa.int64()), ("samples", pa.list_(pa.float64())), ("error", pa.string())]
)
_OPENING = 1 << 16  # what opening a file costs, in bytes
_ROWS = 1 << 10  # rows of short files in a batch
_MOVERS = 32  # threads that move files
_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:/", uri) else (fs.LocalFileSystem(), uri)


@dataclass(frozen=True)
class _Header:
    rate: int
    channels: int
    bits: int
    real: bool
    data: int  # where samples begin
    length: int  # frames

    @property
    def frame(self) -> int:
        return self.channels * self.bits // 8


def _header(f, size: int) -> _Header:
    """What the parts of a file before its samples say; ValueError where they don't make sense."""
    start = f.read(12)
    if len(start) < 12 or start[:4] != b"RIFF" or start[8:] != b"WAVE":
        raise ValueError("no RIFF wave")
    form, at = None, 12
    while True:
        f.seek(at)
        head = f.read(8)
        if len(head) < 8:
            raise ValueError("no samples")
        name, n = struct.unpack("<4sI", head)
        if name == b"fmt ":
            form = f.read(min(n, 40))
            if len(form) < 16:
                raise ValueError("the format is cut off")
        elif name == b"data":
            break
        at += 8 + n + n % 2
    if form is None:
        raise ValueError("no format before the samples")
    kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
    if kind == _EXTENSIBLE and len(form) >= 26:
        kind = struct.unpack("<H", form[24:26])[0]
    if (kind, bits) not in {(_PCM, 8), (_PCM, 16), (_PCM, 24), (_PCM, 32), (_FLOAT, 32), (_FLOAT, 64)} or not channels:
        raise ValueError(f"format {kind} of {bits} bits and {channels} channels isn't read")
    return _Header(rate, channels, bits, kind == _FLOAT, at + 8, min(n, size - at - 8) // (channels * bits // 8))


def _decoded(raw: bytes, h: _Header) -> np.ndarray:
    """Samples in -1..1, interleaved."""
    if h.real:
        return np.frombuffer(raw, f"<f{h.bits // 8}").astype(np.float64)
    if h.bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if h.bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return (wide.view("<i4").ravel() >> 8) / float(1 << 23)
    return np.frombuffer(raw, f"<i{h.bits // 8}") / float(1 << (h.bits - 1))


def _encoded(samples: np.ndarray, bits: int) -> bytes:
    whole = np.rint(np.clip(np.nan_to_num(samples, nan=0.0), -1.0, 1.0) * ((1 << (bits - 1)) - 1)).astype("<i4")
    if bits == 24:
        return whole.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return whole.astype(f"<i{bits // 8}").tobytes()


@dataclass
class _Pieces(InputPartition):
    """(path, size, begin, end) of byte ranges that one task reads."""

    pieces: list[tuple[str, int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.frames = int(options.get("chunkFrames", 1 << 16))
        self.split = int(options.get("splitBytes", 64 << 20))
        self.mono = options.get("channels", "mono") == "mono"
        self.lenient = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        if self.frames < 1 or self.split < 1:
            raise ValueError("chunkFrames and splitBytes must be positive")

    def partitions(self) -> list[_Pieces]:
        system, base = _at(self.folder)
        found = system.get_file_info(base)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
        hidden = lambda p: any(x[:1] in "._" for x in p[len(base) :].strip("/").split("/")) and p != base
        out, held, weight = [], [], 0
        for f in sorted((f for f in files if f.is_file and f.path.lower().endswith(".wav") and not hidden(f.path)), key=lambda f: f.path):
            for a in range(0, max(f.size, 1), self.split):
                b = min(a + self.split, max(f.size, 1))
                if held and weight + b - a > self.split:
                    out.append(_Pieces(held))
                    held, weight = [], 0
                held.append((f.path, f.size, a, b))
                weight += b - a + _OPENING
        return [*out, _Pieces(held)]

    def read(self, partition: _Pieces) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._rows(partition):
            rows.append(row)
            held += 0 if row[7] is None else len(row[7])
            if held >= self.frames or len(rows) >= _ROWS:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _rows(self, partition: _Pieces) -> Iterator[tuple]:
        system, base = _at(self.folder)
        for path, size, a, b in partition.pieces:
            name = path[len(base) :].strip("/") or path.rsplit("/", 1)[-1]
            with system.open_input_file(path) as f:
                try:
                    h = _header(f, size)
                except ValueError as e:
                    if not self.lenient:
                        raise ValueError(f"{path}: {e}") from e
                    if a == 0:
                        yield (name, *(None,) * 7, str(e))
                    continue
                yield from self._chunks(f, name, h, a, b)

    def _chunks(self, f, name: str, h: _Header, a: int, b: int) -> Iterator[tuple]:
        told = (h.rate, h.channels, h.bits, h.length)
        if not h.length and a == 0:
            yield (name, 0, 0, *told, np.empty(0), None)
        step = self.frames * h.frame
        first, behind = (max(0, -(-(x - h.data) // step)) for x in (a, b))
        for k in range(first, min(behind, -(-h.length // self.frames))):
            offset = k * self.frames
            n = min(self.frames, h.length - offset)
            f.seek(h.data + offset * h.frame)
            samples = _decoded(f.read(n * h.frame), h)
            if self.mono and h.channels > 1:
                samples = samples.reshape(-1, h.channels).mean(axis=1)
            yield (name, k, offset, *told, samples, None)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        lists = [np.empty(0) if x is None else x for x in columns[7]]
        ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        samples = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists), pa.float64()), mask=pa.array([x is None for x in columns[7]]))
        return pa.RecordBatch.from_arrays([samples if i == 7 else pa.array(c, t) for i, (c, t) in enumerate(zip(columns, _ARROW.types))], schema=_ARROW)


@dataclass
class _Staged(WriterCommitMessage):
    """The folder of a task's files; none where it had no rows. Its file `names` has their paths below the final folder, one a line, in the order of their numbers."""

    folder: str | None


class _File:
    """A file that grows chunk by chunk."""

    def __init__(self, system: fs.FileSystem, path: str, length: int, rate: int, bits: int, channels: int):
        self.left, self.bits, self.next = length * channels, bits, 0
        n = length * channels * bits // 8
        if n > 0xFFFFFFFF - 64:
            raise ValueError(f"{path}: {n} bytes of samples don't fit the format")
        self.pad = n % 2
        self.out = system.open_output_stream(path)
        frame = channels * bits // 8
        self.out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + self.pad, b"WAVE", b"fmt ", 16, _PCM, channels, rate, rate * frame, frame, bits, b"data", n))

    def add(self, chunk: int, samples: np.ndarray) -> None:
        if chunk != self.next or len(samples) > self.left:
            raise ValueError(f"chunk {chunk} of {len(samples)} samples where chunk {self.next} of at most {self.left} should come")
        self.out.write(_encoded(samples, self.bits))
        self.next, self.left = chunk + 1, self.left - len(samples)

    def close(self) -> None:
        if self.left:
            raise ValueError(f"{self.left} samples are missing")
        self.out.write(b"\0" * self.pad)
        self.out.close()


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.rate, self.bits, self.channels = int(options["rate"]), int(options.get("bits", 24)), int(options.get("channels", 1))
        if self.bits not in (16, 24, 32) or self.rate < 1 or self.channels < 1:
            raise ValueError("bits must be 16, 24 or 32, rate and channels positive")
        self.staging = f"{_at(self.folder)[1].rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        system, _ = _at(self.folder)
        own, name, now, names, n = f"{self.staging}/{uuid.uuid4().hex}", None, None, None, 0
        for batch in iterator:
            samples = batch["samples"]
            for i, (path, chunk, length) in enumerate(zip(*(batch[c].to_pylist() for c in ("path", "chunk", "length")))):
                if not path or path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path!r} names no file below the folder")
                if path != name:
                    if now:
                        now.close()
                    if names is None:
                        system.create_dir(own, recursive=True)
                        names = system.open_output_stream(f"{own}/names")
                    name, now, n = path, _File(system, f"{own}/{n}.wav", length, self.rate, self.bits, self.channels), n + 1
                    names.write(json.dumps(f"{path}.wav").encode() + b"\n")
                now.add(chunk, samples[i].values.to_numpy(zero_copy_only=False).astype(np.float64) if samples[i].is_valid else np.empty(0))
        if now:
            now.close()
            names.close()
        return _Staged(own if now else None)

    def commit(self, messages: list[_Staged | None]) -> None:
        system, base = _at(self.folder)
        system.create_dir(base, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(base, recursive=True)):
                if f.is_file and f.path.endswith(".wav") and not f.path.startswith(self.staging):
                    system.delete_file(f.path)
        there: set[str] = set()

        def move(folder: str) -> None:
            with system.open_input_stream(f"{folder}/names") as f:
                for n, line in enumerate(io.BufferedReader(f)):
                    final = f"{base.rstrip('/')}/{json.loads(line)}"
                    if (at := final.rsplit("/", 1)[0]) not in there:
                        system.create_dir(at, recursive=True)
                        there.add(at)
                    system.move(f"{folder}/{n}.wav", final)

        with ThreadPoolExecutor(_MOVERS) as pool:
            list(pool.map(move, [m.folder for m in messages if m and m.folder]))
        self.abort(messages)

    def abort(self, messages: list[_Staged | None]) -> None:
        system, _ = _at(self.folder)
        if system.get_file_info(self.staging).type == fs.FileType.Directory:
            system.delete_dir(self.staging)


class WaveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wave"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def read_waves(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(WaveSource)
    return spark.read.format("wave").options(**options).load(folder)


def write_waves(chunks: DataFrame, folder: str, rate: int, bits: int = 24, channels: int = 1, mode: str = "append") -> None:
    """chunks (path without its ending, chunk from 0, length in frames, samples) as files. The chunks of a file go to one task, in order."""
    chunks.sparkSession.dataSource.register(WaveSource)
    dealt = chunks.select("path", F.col("chunk").cast("bigint").alias("chunk"), F.col("length").cast("bigint").alias("length"), F.col("samples").cast("array<double>").alias("samples")).repartition("path").sortWithinPartitions("path", "chunk")
    dealt.write.format("wave").options(rate=rate, bits=bits, channels=channels).mode(mode).save(folder)


def peak_normalised(chunks: DataFrame) -> DataFrame:
    """chunks (path, samples) over the largest sample of their file; silence stays."""
    own = F.coalesce(F.array_max(F.transform("samples", lambda v: F.abs(v))), F.lit(0.0))
    peaks = chunks.groupBy("path").agg(F.max(own).alias("_peak"))
    return chunks.join(peaks, "path").withColumn("samples", F.when(F.col("_peak") > 0, F.transform("samples", lambda v: v / F.col("_peak"))).otherwise(F.col("samples"))).drop("_peak")


def segment_name(index: Column, voiced: Column, duration: Column, library: Column | None = None) -> Column:
    """segment_001_human_lib_2.5: number, label, a mark of library segments, seconds (left out where null)."""
    mark = F.when(library, "_lib").otherwise("") if library is not None else F.lit("")
    label = F.when(F.coalesce(voiced, F.lit(True)), "human").otherwise("music")
    return F.concat(F.format_string("segment_%03d_", index), label, mark, F.when(duration.isNotNull(), F.format_string("_%.1f", F.greatest(F.lit(0.0), duration))).otherwise(""))


def write_segments(pieces: DataFrame, folder: str, rate: int, **options) -> DataFrame:
    """pieces (track, piece from 0, samples, voiced and, if there, library) as a file each, in a folder for each track. Returns track, piece and path."""
    library = F.col("library") if "library" in pieces.columns else None
    name = segment_name(F.col("piece") + 1, F.col("voiced"), F.size("samples") / F.lit(float(rate)), library)
    named = pieces.withColumn("path", F.concat_ws("/", F.col("track").cast("string"), name))
    write_waves(named.select("path", F.lit(0).alias("chunk"), F.size("samples").alias("length"), "samples"), folder, rate, **options)
    return named.select("track", "piece", F.concat("path", F.lit(".wav")).alias("path"))
