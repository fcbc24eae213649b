"""Segments: sorted Parquet folders with a Bloom filter on the key and a list of their files."""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.errors import CorruptError
from versionlog.functions.versions import SCHEMA, encoded_size
from versionlog.sources.fsio import Fs, put_in_place
from versionlog.sources.manifest import Segment

FOLDER = "segments"
#: The list of a segment's files, in key order; Spark does not read names that begin like this.
FILES = "_files.json"
#: Small row groups, so that key ranges and single keys read little.
ROW_GROUP = 2 << 20


@dataclass(frozen=True)
class DataFile:
    """One file of a segment. Files are in the order of (key, newest first), so their key ranges only touch."""

    name: str
    rows: int
    min_key: bytes
    max_key: bytes


def path_of(root: str, segment: Segment | str) -> str:
    return f"{root}/{FOLDER}/{segment if isinstance(segment, str) else segment.id}"


def described(spark: SparkSession, root: str, name: str) -> tuple[Segment, list[DataFile]]:
    """What a manifest holds of a segment, and its files: one pass, a row for each file on the driver."""
    rows = (
        read(spark, [path_of(root, name)])
        .groupBy(F.col("_metadata.file_name").alias("file"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(encoded_size(F.col("key"), F.col("value"))).cast("long").alias("bytes"),
            F.min("key").alias("min_key"),
            F.max("key").alias("max_key"),
            F.min("seq").alias("min_seq"),
            F.max("seq").alias("max_seq"),
        )
        .collect()
    )
    files = sorted((DataFile(r["file"], r["rows"], bytes(r["min_key"]), bytes(r["max_key"])) for r in rows), key=lambda f: (f.min_key, f.max_key, f.name))
    if not rows:
        return Segment(id=name, rows=0, bytes=0), []
    return Segment(
        id=name,
        rows=sum(r["rows"] for r in rows),
        bytes=sum(r["bytes"] for r in rows),
        min_key=files[0].min_key.hex().upper(),
        max_key=max(f.max_key for f in files).hex().upper(),
        min_seq=min(r["min_seq"] for r in rows),
        max_seq=max(r["max_seq"] for r in rows),
    ), files


def write(fs: Fs, root: str, versions: DataFrame, *, bloom: bool = True, partitions: int | None = None) -> Segment:
    """Write ``versions`` as a new segment under a name that is never used again.

    Ranges are over (key, seq), so a key with very many versions takes several files instead
    of one task; row-group statistics prune by key all the same.
    """
    name = uuid.uuid4().hex
    rows = versions.select("key", "seq", "value")
    by = [F.col("key"), F.desc("seq")]
    ranged = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    out = ranged.sortWithinPartitions(*by).write.mode("errorifexists").option("parquet.block.size", str(ROW_GROUP))
    if bloom:
        out = out.option("parquet.bloom.filter.enabled#key", "true")
    out.parquet(_uri(path_of(root, name)))
    made, files = described(versions.sparkSession, root, name)
    listed = [[f.name, f.rows, f.min_key.hex(), f.max_key.hex()] for f in files]
    put_in_place(fs, f"{path_of(root, name)}/{FILES}", json.dumps(listed).encode(), False)  # synced with the folder
    return made


def files_of(fs: Fs, root: str, segment: Segment) -> list[DataFile] | None:
    """The files of a segment in key order; None if they are not listed."""
    path = f"{path_of(root, segment)}/{FILES}"
    if not fs.exists(path):
        return None
    try:
        found = [DataFile(name, rows, bytes.fromhex(a), bytes.fromhex(b)) for name, rows, a, b in json.loads(fs.read(path))]
    except (ValueError, TypeError) as e:
        raise CorruptError("a segment's list of files cannot be read") from e
    if sum(f.rows for f in found) != segment.rows:
        raise CorruptError("a segment's list of files does not match the manifest")
    return found


def overlapping(files: Sequence[DataFile], start: bytes | None, end: bytes | None) -> list[DataFile]:
    """The files that may hold a key of [start, end)."""
    return [f for f in files if not (start is not None and f.max_key < start) and not (end is not None and f.min_key >= end)]


def holding(files: Sequence[DataFile], keys: Sequence[bytes]) -> list[DataFile]:
    """The files that may hold one of some sorted keys."""
    out = []
    for f in files:
        at = bisect_left(keys, f.min_key)
        if at < len(keys) and keys[at] <= f.max_key:
            out.append(f)
    return out


def _uri(path: str) -> str:
    return f"file://{path}"  # whatever file system is the session's default


def read(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """All versions of some segments or files; a damaged file is an error, not an end."""
    found = [_uri(p) for p in paths]
    if not found:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false").parquet(*found)
