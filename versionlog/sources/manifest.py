"""Manifests: which segments a store consists of. One file for each version of the table."""

from __future__ import annotations

import json
import zlib
from dataclasses import asdict, dataclass, field, replace

from versionlog.errors import BadFormatError, CorruptError
from versionlog.sources.fsio import Fs, put_in_place

FORMAT = 1
FOLDER, POINTER = "manifests", "CURRENT"


@dataclass(frozen=True)
class Segment:
    """An immutable Parquet folder, sorted by key and, within a key, newest first."""

    id: str
    rows: int
    bytes: int
    min_key: str | None = None  # hex, so that order is kept
    max_key: str | None = None
    min_seq: int | None = None
    max_seq: int | None = None

    def may_hold(self, start: bytes | None, end: bytes | None, bound: int | None = None) -> bool:
        """False only if no version of [start, end) below the bound can be inside."""
        if not self.rows:
            return False
        if bound is not None and self.min_seq is not None and self.min_seq >= bound:
            return False
        if self.min_key is None or self.max_key is None:
            return True
        return not (start is not None and bytes.fromhex(self.max_key) < start) and not (end is not None and bytes.fromhex(self.min_key) >= end)


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_seq: int = 0
    flushed_seq: int = 0
    segments: tuple[Segment, ...] = ()
    last_commit: int = -1  # first seq of the last commit before this version, so that a lost one is seen
    streams: dict[str, int] = field(default_factory=dict)

    def following(self, **changes: object) -> Manifest:
        return replace(self, version=self.version + 1, **changes)  # type: ignore[arg-type]


def encode(m: Manifest) -> bytes:
    body = json.dumps(asdict(m), sort_keys=True)
    return json.dumps({"format": FORMAT, "crc": zlib.crc32(body.encode()), "body": body}).encode()


def decode(data: bytes) -> Manifest:
    """Fails on anything but a whole manifest; never returns an empty one instead."""
    try:
        outer = json.loads(data)
        kind, crc, body = outer["format"], outer["crc"], outer["body"]
    except (ValueError, KeyError, TypeError) as e:
        raise CorruptError("the manifest cannot be read") from e
    if kind != FORMAT:
        raise BadFormatError(f"manifest format {kind} is unknown")
    if not isinstance(body, str) or zlib.crc32(body.encode()) != crc:
        raise CorruptError("the manifest's checksum does not match")
    try:
        fields = json.loads(body)
        segments = tuple(Segment(**s) for s in fields.pop("segments"))
        return Manifest(segments=segments, **fields)
    except (ValueError, KeyError, TypeError) as e:
        raise CorruptError("the manifest has an unknown shape") from e


def path_of(root: str, version: int) -> str:
    return f"{root}/{FOLDER}/manifest-{version:010d}.json"


def publish(fs: Fs, root: str, m: Manifest, sync: bool) -> None:
    """Make ``m`` the current version: one rename decides."""
    fs.make(f"{root}/{FOLDER}")
    put_in_place(fs, path_of(root, m.version), encode(m), sync)
    put_in_place(fs, f"{root}/{POINTER}", f"{m.version}".encode(), sync)


def load(fs: Fs, root: str) -> Manifest | None:
    """The current manifest; None only if the store has never been written."""
    pointer = f"{root}/{POINTER}"
    if not fs.exists(pointer):
        return None
    try:
        version = int(fs.read(pointer))
    except ValueError as e:
        raise CorruptError("CURRENT does not name a version") from e
    path = path_of(root, version)
    if not fs.exists(path):
        raise CorruptError(f"manifest {version} is missing")
    m = decode(fs.read(path))
    if m.version != version:
        raise CorruptError("the manifest has another version than its name")
    return m
