"""The small file interface under a store, so that faults can be injected.

Manifests, commits, file lists, the pointer file and the lock go through it, and so does all
syncing, copying and removing of segments. The bytes of data files are written and read by Spark.
"""

from __future__ import annotations

import fcntl
import os
import shutil
from typing import Protocol

from versionlog.errors import LockedError

SYNC_MODES = ("durable", "barrier", "none")


class Fs(Protocol):
    def read(self, path: str) -> bytes: ...
    def write(self, path: str, data: bytes, sync: bool) -> None: ...
    def replace(self, source: str, target: str) -> None: ...
    def remove(self, path: str) -> None: ...
    def names(self, path: str) -> list[str]: ...
    def exists(self, path: str) -> bool: ...
    def make(self, path: str) -> None: ...
    def sync_file(self, path: str) -> None: ...
    def sync_folder(self, path: str) -> None: ...
    def remove_tree(self, path: str) -> None: ...
    def copy(self, source: str, target: str) -> None: ...
    def link(self, source: str, target: str) -> None: ...
    def lock(self, path: str) -> object: ...
    def unlock(self, handle: object) -> None: ...


class StdFs:
    """The operating system's files."""

    def read(self, path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()

    def write(self, path: str, data: bytes, sync: bool) -> None:
        with open(path, "wb") as f:
            f.write(data)
            if sync:
                f.flush()
                os.fsync(f.fileno())

    def replace(self, source: str, target: str) -> None:
        os.replace(source, target)

    def remove(self, path: str) -> None:
        os.remove(path)

    def names(self, path: str) -> list[str]:
        return sorted(os.listdir(path))

    def exists(self, path: str) -> bool:
        return os.path.exists(path)

    def make(self, path: str) -> None:
        os.makedirs(path, exist_ok=True)

    def sync_file(self, path: str) -> None:
        fd = os.open(path, os.O_RDONLY)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)

    def sync_folder(self, path: str) -> None:
        self.sync_file(path)

    def remove_tree(self, path: str) -> None:
        shutil.rmtree(path, ignore_errors=True)

    def copy(self, source: str, target: str) -> None:
        shutil.copy2(source, target)

    def link(self, source: str, target: str) -> None:
        os.link(source, target)

    def lock(self, path: str) -> object:
        fd = os.open(path, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            os.close(fd)
            raise LockedError(f"{path} is held by another handle") from e
        return fd

    def unlock(self, handle: object) -> None:
        os.close(int(handle))  # type: ignore[call-overload]


def put_in_place(fs: Fs, path: str, data: bytes, sync: bool) -> None:
    """All of ``data`` under ``path``, or nothing: written aside, then renamed."""
    aside = f"{path}.tmp"
    try:
        fs.write(aside, data, sync)
        fs.replace(aside, path)
    except BaseException:
        if fs.exists(aside):
            try:
                fs.remove(aside)
            except OSError:
                pass
        raise
    if sync:
        fs.sync_folder(os.path.dirname(path))


def sync_all(fs: Fs, folder: str) -> None:
    """The files of a flat folder, then the folder, then its entry in the folder above."""
    for name in fs.names(folder):
        fs.sync_file(f"{folder}/{name}")
    fs.sync_folder(folder)
    fs.sync_folder(os.path.dirname(folder))
