"""The store: states, snapshots, recovery, faults and checkpoints."""

import os
import shutil

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from versionlog.errors import BadFormatError, CorruptError, LockedError, PoisonedError, StoreError, StoreIOError
from versionlog.plans.store import Options, Store, WriteBatch
from versionlog.sources import commits, manifest
from versionlog.sources.fsio import StdFs

SMALL = Options(flush_threshold_bytes=256, compaction_threshold=3, sync_mode="none")


class FailingFs(StdFs):
    """Fails the operation that a test names, on paths that contain a text."""

    def __init__(self):
        self.fail, self.calls = None, []

    def _step(self, name, path):
        self.calls.append((name, path))
        if self.fail and self.fail[0] == name and self.fail[1] in path:
            raise OSError(f"injected: {name} {path}")

    def write(self, path, data, sync):
        self._step("write", path)
        super().write(path, data, sync)

    def replace(self, source, target):
        self._step("replace", target)
        super().replace(source, target)

    def sync_file(self, path):
        self._step("sync_file", path)
        super().sync_file(path)

    def remove(self, path):
        self._step("remove", path)
        super().remove(path)


#: Keys of many shapes: empty, prefixes of others, bytes from 0x80 on, and paths of unequal length.
SHAPES = sorted({b"", b"\x00", b"\xff", b"\xff\xff", b"\x80", *(b"/".join([b"berlin", b"oslo", b"rome"][: 1 + i % 3]) + b"/%x" % (i * i) for i in range(24))})
RANGES = [(None, None), (b"", b"berlin/"), (b"berlin/", None), (b"berlin/4", b"berlin/oslo/rome"), (b"\x80", None), (b"oslo", b"berlin"), (b"berlin/9", b"berlin/9")]


def expect(store, want):
    for start, end in RANGES:
        keys = sorted(k for k in want if (start is None or k >= start) and (end is None or k < end))
        for limit in (None, 0, 1, 4, 1000):
            assert store.scan(start, end, limit) == [(k, want[k]) for k in (keys if limit is None else keys[:limit])], (start, end, limit)
    for k in [*SHAPES, b"berlin", b"paris"]:
        assert store.get(k) == want.get(k)


def test_reads_agree_however_the_versions_are_stored(spark, tmp_path):
    root, want = str(tmp_path / "s"), {}

    def apply(store, ops):
        for key, value in ops:
            if value is None:
                store.delete(key)
                want.pop(key, None)
            else:
                store.put(key, value)
                want[key] = value

    store = Store.open(spark, root, SMALL)
    expect(store, want)  # nothing yet
    bulk = [(k, b"bulk" * (i % 3)) for i, k in enumerate(SHAPES)]
    rows = spark.createDataFrame([(i, bytearray(k), bytearray(v)) for i, (k, v) in enumerate(bulk)], "op_index long, key binary, value binary")
    store.write_dataframe(rows)
    want.update(bulk)
    expect(store, want)  # one commit that is a segment
    apply(store, [(k, None) for k in SHAPES[::4]] + [(k, k[::-1]) for k in SHAPES[2::5]])
    expect(store, want)  # a buffer over it
    store.close()
    store = Store.open(spark, root, SMALL)
    expect(store, want)  # replayed
    store.flush_only()
    apply(store, [(k, b"again") for k in SHAPES[1::6]])
    store.flush_only()
    apply(store, [(SHAPES[0], b"last"), (SHAPES[-1], None)])
    expect(store, want)  # three segments and a buffer
    while store.compact_step():
        pass
    store.vacuum()
    expect(store, want)  # merged under a buffer
    store.flush()
    expect(store, want)
    store.close()


def test_snapshots_survive_rewrites_flush_and_merge(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), SMALL) as store:
        for i in range(10):
            store.put(b"k%d" % i, b"before")
        with store.snapshot() as snap:
            batch = WriteBatch()
            for i in range(10):
                batch.put(b"k%d" % i, b"after")
            batch.delete(b"k3")
            store.write_batch(batch)
            for _ in range(3):
                store.flush_only()
                store.put(b"x", b"x")
            store.flush()
            assert {v for _, v in store.scan_at(snap)} == {b"before"} and len(store.scan_at(snap)) == 10
            assert store.get_at(snap, b"k3") == b"before" and store.get(b"k3") is None
            assert len(store.scan(b"k", b"l")) == 9
        with pytest.raises(StoreError):
            store.get_at(snap, b"k3")
        store.flush()


def test_batches_are_ordered_and_empty_values_are_not_deletes(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), SMALL) as store:
        store.write_batch(WriteBatch())
        assert store.snapshot().horizon == 0
        store.write_batch(WriteBatch().put(b"k", b"1").put(b"k", b"2").put(b"gone", b"x").delete(b"gone").put(b"", b"").put(b"\xff", b""))
        assert store.scan() == [(b"", b""), (b"k", b"2"), (b"\xff", b"")]
        store.delete(b"never there")
        store.flush_only()
        assert store.scan() == [(b"", b""), (b"k", b"2"), (b"\xff", b"")]
        assert [r.seq for r in store.versions_of(b"k").collect()] == [1, 0]


def test_one_handle_at_a_time(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store.open(spark, root, SMALL), pytest.raises(LockedError):
        Store.open(spark, root, SMALL)
    Store.open(spark, root, SMALL).close()


def test_failed_commit_leaves_no_trace(spark, tmp_path):
    fs, root = FailingFs(), str(tmp_path / "s")
    store = Store.open(spark, root, SMALL, fs)
    store.put(b"a", b"1")
    for step in ("write", "replace"):
        fs.fail = (step, "commit")
        with pytest.raises(StoreIOError):
            store.put(b"bad", b"x")
        fs.fail = None
        store.put(b"b", b"2")
    store.close()
    with Store.open(spark, root, SMALL) as again:
        assert again.scan() == [(b"a", b"1"), (b"b", b"2")]


@pytest.mark.parametrize("path", ["manifest-", "CURRENT"])
def test_failed_publish_latches_and_reopen_recovers(spark, tmp_path, path):
    fs, root = FailingFs(), str(tmp_path / "s")
    store = Store.open(spark, root, SMALL, fs)
    for i in range(4):
        store.put(b"k", b"%d" % i)
        store.put(b"d", b"old")
        store.flush_only()
    store.delete(b"d")
    store.flush_only()
    fs.fail = ("replace", path)
    with pytest.raises(StoreIOError):
        store.compact_step()
    fs.fail = None
    for call in (lambda: store.put(b"x", b"y"), lambda: store.get(b"k"), lambda: store.scan(), store.flush_only):
        with pytest.raises(PoisonedError):
            call()
    store.close()
    with Store.open(spark, root, SMALL) as again:
        assert again.scan() == [(b"k", b"3")]  # the deleted key stays deleted
        again.put(b"n", b"1")
    with Store.open(spark, root, SMALL) as again:  # reopen, write, reopen
        assert again.scan() == [(b"k", b"3"), (b"n", b"1")]
        again.flush()
        assert again.scan() == [(b"k", b"3"), (b"n", b"1")]


def test_flush_that_ended_before_its_commits_were_removed(spark, tmp_path):
    root = str(tmp_path / "s")
    store = Store.open(spark, root, SMALL)
    store.put(b"a", b"1")
    kept = commits.path_of(root, 0)
    shutil.copy(kept, str(tmp_path / "copy"))
    store.flush_only()
    store.close()
    shutil.copy(str(tmp_path / "copy"), kept)
    with Store.open(spark, root, SMALL) as again:
        assert again.scan() == [(b"a", b"1")] and not again._buffer.versions
        assert again.snapshot().horizon == 1


def test_unreadable_manifest_is_never_empty(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store.open(spark, root, SMALL) as store:
        store.put(b"a", b"1")
        store.flush_only()
        path = manifest.path_of(root, store._manifest.version)
    good = open(path, "rb").read()
    for bad in (good[:-5], b"", good.replace(b'"crc": ', b'"crc": 1'), b"{}"):
        open(path, "wb").write(bad)
        with pytest.raises(CorruptError):
            Store.open(spark, root, SMALL)
    open(path, "wb").write(good.replace(b'"format": 1', b'"format": 9'))
    with pytest.raises(BadFormatError):
        Store.open(spark, root, SMALL)
    os.remove(path)
    with pytest.raises(CorruptError):
        Store.open(spark, root, SMALL)
    open(path, "wb").write(good)
    with Store.open(spark, root, SMALL) as store:
        assert store.scan() == [(b"a", b"1")]


def test_commits_cut_anywhere_are_refused():
    data = commits.encode(7, [(b"k%d" % i, None if i == 3 else b"v%d" % i) for i in range(8)])
    assert [v[1] for v in commits.decode(data)] == list(range(7, 15))
    for n in range(len(data)):
        with pytest.raises((CorruptError, BadFormatError)):
            commits.decode(data[:n])


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80))
def test_decoders_survive_any_bytes(data):
    for decode in (commits.decode, manifest.decode):
        with pytest.raises(StoreError):
            decode(data)


def test_checkpoint_is_independent(spark, tmp_path):
    root, copy = str(tmp_path / "s"), str(tmp_path / "c")
    with Store.open(spark, root, SMALL) as store:
        for i in range(20):
            store.put(b"k%02d" % i, b"v")
            if i % 5 == 4:
                store.flush_only()
        store.put(b"buffered", b"yes")
        store.checkpoint(copy)
        store.put(b"later", b"no")
        with pytest.raises(StoreIOError):
            store.checkpoint(copy)
        store.flush()
        store.vacuum()
    shutil.rmtree(root)
    with Store.open(spark, copy, SMALL) as again:
        assert len(again.scan()) == 21 and again.get(b"buffered") == b"yes" and again.get(b"later") is None
        again.put(b"own", b"1")
        assert again.get(b"own") == b"1"


def test_directory_without_manifest_is_adopted_above_its_seqs(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store.open(spark, root, SMALL) as store:
        store.put(b"a", b"old")
        store.flush_only()
    shutil.rmtree(f"{root}/manifests")
    os.remove(f"{root}/CURRENT")
    with Store.open(spark, root, SMALL) as again:
        again.put(b"a", b"new")
        assert again.get(b"a") == b"new" and again.scan() == [(b"a", b"new")]
        again.flush()
        assert again.scan() == [(b"a", b"new")]


def test_maintain_does_one_unit_and_ends(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), SMALL) as store:
        for i in range(40):
            store.put(b"k%02d" % (i % 9), b"x" * 20)
            while store.pending_work():
                assert store.maintain()
        assert not store.maintain() and store.segment_count >= 1
        assert len(store.scan()) == 9


def test_background_thread_keeps_up(spark, tmp_path):
    options = Options(flush_threshold_bytes=256, compaction_threshold=3, sync_mode="none", maintenance="threads")
    with Store.open(spark, str(tmp_path / "s"), options) as store:
        for i in range(60):
            store.put(b"k%02d" % (i % 11), b"%d" % i)
        assert len(store.scan()) == 11
    with Store.open(spark, str(tmp_path / "s"), SMALL) as store:
        assert dict(store.scan())[b"k04"] == b"59"


def test_bulk_commit_numbers_rows_in_order(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), SMALL) as store:
        store.put(b"k1", b"first")
        ops = spark.range(1000).selectExpr("id as op_index", "concat('k', id % 10) as key", "case when id < 995 then concat('v', id) end as value")
        assert store.write_dataframe(ops.orderBy("value")) == 1000
        assert store.get(b"k4") == b"v994" and store.get(b"k5") is None and store.get(b"k1") == b"v991"
        assert len(store.scan()) == 5
        store.put(b"k5", b"again")
        store.flush()
        assert dict(store.scan())[b"k5"] == b"again"
        assert store.log().selectExpr("count(distinct seq) as n").first().n == 1002


def test_stream_batches_are_published_once(spark, tmp_path):
    from versionlog.streaming import ingest

    source = str(tmp_path / "in")
    rows = spark.range(6).selectExpr("id as op_index", "concat('k', id % 3) as key", "concat('v', id) as value")
    rows.coalesce(1).write.parquet(source)
    with Store.open(spark, str(tmp_path / "s"), SMALL) as store:
        def run():
            stream = spark.readStream.schema(rows.schema).parquet(source)
            ingest(stream, store, "src", str(tmp_path / "cp")).awaitTermination()

        run()
        assert store.scan() == [(b"k0", b"v3"), (b"k1", b"v4"), (b"k2", b"v5")]
        assert store.write_dataframe(rows, stream=("src", 0)) == 0  # a replay
        rows.selectExpr("op_index", "key", "'new' as value").coalesce(1).write.mode("append").parquet(source)
        run()
        assert {v for _, v in store.scan()} == {b"new"}


# Ten two-byte keys, so that operations meet on keys. Reads, snapshots and reopening are as likely as
# writes: each looks at the states that flushes and merges leave behind.
KEYS = st.integers(0, 9).map(lambda i: b"%02d" % i)
VALUES = st.binary(max_size=12)
STEPS = st.lists(
    st.one_of(
        st.tuples(st.just("put"), KEYS, VALUES),
        st.tuples(st.just("delete"), KEYS),
        st.tuples(st.just("batch"), st.lists(st.tuples(KEYS, st.none() | VALUES), max_size=6)),
        st.tuples(st.just("get"), KEYS),
        st.tuples(st.sampled_from(["flush", "merge", "snapshot", "release", "reopen"])),
    ),
    max_size=18,
)
MODEL = Options(flush_threshold_bytes=1 << 10, compaction_threshold=2, sync_mode="none")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(STEPS)
def test_store_behaves_like_a_map(spark, tmp_path_factory, steps):
    root = str(tmp_path_factory.mktemp("model") / "s")
    store, want, snaps = Store.open(spark, root, MODEL), {}, []

    def write(key, value):
        want.pop(key, None)
        if value is not None:
            want[key] = value

    for kind, *rest in steps:
        if kind == "put":
            store.put(*rest)
            write(*rest)
        elif kind == "delete":
            store.delete(*rest)
            write(*rest, None)
        elif kind == "batch":
            batch = WriteBatch()
            for key, value in rest[0]:
                batch.delete(key) if value is None else batch.put(key, value)
                write(key, value)
            store.write_batch(batch)
        elif kind == "get":
            assert store.get(rest[0]) == want.get(rest[0])
            for snap, then in snaps:
                assert store.get_at(snap, rest[0]) == then.get(rest[0])
        elif kind == "flush":
            store.flush_only()
        elif kind == "merge":
            store.compact_step()
        elif kind == "snapshot":
            snaps.append((store.snapshot(), dict(want)))
        elif kind == "release" and snaps:
            snaps.pop(0)[0].close()
        elif kind == "reopen":
            snaps.clear()
            store.close()
            store = Store.open(spark, root, MODEL)
    assert dict(store.scan()) == want and store.scan(limit=3) == sorted(want.items())[:3]
    for snap, then in snaps:
        assert dict(store.scan_at(snap)) == then and store.scan_at(snap, limit=2) == sorted(then.items())[:2]
    store.close()


def test_command_line(spark, tmp_path, capsys):
    from versionlog.cli import main

    root = str(tmp_path / "s")
    assert main([root, "put", "k", "v"]) == 0 and main([root, "flush"]) == 0
    assert main([root, "get", "k"]) == 0 and capsys.readouterr().out == "v\n"
    assert main([root, "delete", "k"]) == 0 and main([root, "get", "k"]) == 0
    assert capsys.readouterr().out == "(nil)\n"


DURABLE = Options(flush_threshold_bytes=1 << 20, compaction_threshold=2, sync_mode="durable")


def test_segments_are_on_disk_before_a_manifest_names_them(spark, tmp_path):
    fs, root = FailingFs(), str(tmp_path / "s")
    rows = spark.range(50).selectExpr("id as op_index", "concat('k', id) as key", "'v' as value")
    with Store.open(spark, root, DURABLE, fs) as store:
        flushed = lambda: (store.put(b"a", b"1"), store.flush_only())
        for step in (flushed, flushed, lambda: store.write_dataframe(rows), store.compact_step):
            before = {s.id for s in store._manifest.segments}
            fs.calls.clear()
            step()
            (made,) = {s.id for s in store._manifest.segments} - before
            synced = {p for name, p in fs.calls[: fs.calls.index(("replace", f"{root}/CURRENT"))] if name == "sync_file"}
            folder = f"{root}/segments/{made}"
            assert {f"{folder}/{n}" for n in os.listdir(folder)} | {folder, f"{root}/segments"} <= synced
            gone = [i for i, (name, p) in enumerate(fs.calls) if name == "remove" and "commit-" in p]
            assert all(i > fs.calls.index(("replace", f"{root}/CURRENT")) for i in gone)
        fs.calls.clear()
        store.checkpoint(str(tmp_path / "c"))
        named = f"{tmp_path}/c/CURRENT"
        copied = [p for name, p in fs.calls[: fs.calls.index(("replace", named))] if name == "sync_file" and p.startswith(f"{tmp_path}/c/segments/")]
        assert len(copied) >= len(os.listdir(f"{tmp_path}/c/segments/{store._manifest.segments[0].id}"))


def test_failed_sync_of_a_segment_latches_and_loses_nothing(spark, tmp_path):
    fs, root = FailingFs(), str(tmp_path / "s")
    store = Store.open(spark, root, DURABLE, fs)
    store.put(b"a", b"1")
    fs.fail = ("sync_file", "segments/")
    with pytest.raises(StoreIOError):
        store.flush_only()
    store.close()
    with Store.open(spark, root, DURABLE) as again:
        assert again.scan() == [(b"a", b"1")]


def test_one_synced_file_for_each_batch(spark, tmp_path):
    class Counting(StdFs):
        synced = 0

        def write(self, path, data, sync):
            self.synced += sync and "commit-" in path
            super().write(path, data, sync)

    fs = Counting()
    with Store.open(spark, str(tmp_path / "s"), DURABLE, fs) as store:
        batch = WriteBatch()
        for i in range(70):
            batch.put(b"%d" % i, b"x")
        store.write_batch(batch)
        assert fs.synced == 1
        for i in range(5):
            store.put(b"%d" % i, b"y")
        assert fs.synced == 6


def test_a_lost_commit_is_an_error(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store.open(spark, root, SMALL) as store:
        store.put(b"zero", b"0")
        store.flush_only()
        for k in (b"a", b"b", b"c"):
            store.put(k, b"1")
        rows = spark.range(3).selectExpr("id as op_index", "concat('r', id) as key", "'v' as value")
        store.write_dataframe(rows)  # its seqs are no gap
        store.put(b"d", b"1")
    files = sorted(os.listdir(f"{root}/commits"))
    assert len(files) == 4
    for lost in files[:3]:  # the third is known to the manifest of the bulk commit, too
        os.rename(f"{root}/commits/{lost}", str(tmp_path / lost))
        with pytest.raises(CorruptError):
            Store.open(spark, root, SMALL)
        os.rename(str(tmp_path / lost), f"{root}/commits/{lost}")
    with Store.open(spark, root, SMALL) as again:
        assert [k for k, _ in again.scan()] == [b"a", b"b", b"c", b"d", b"r0", b"r1", b"r2", b"zero"]
        again.put(b"e", b"1")
    os.remove(f"{root}/commits/{files[3]}")
    with pytest.raises(CorruptError):
        Store.open(spark, root, SMALL)


def test_a_torn_last_commit_is_dropped_and_writing_goes_on(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store.open(spark, root, SMALL) as store:
        store.put(b"a", b"1")
        store.put(b"b", b"2")
    first, last = (commits.path_of(root, i) for i in (0, 1))
    whole = open(last, "rb").read()
    for n in (0, 5, len(whole) - 1):
        open(last, "wb").write(whole[:n])
        with Store.open(spark, root, SMALL) as again:
            assert again.scan() == [(b"a", b"1")]
            again.put(b"c", b"%d" % n)
        with Store.open(spark, root, SMALL) as again:
            assert again.scan() == [(b"a", b"1"), (b"c", b"%d" % n)]
    open(first, "wb").write(open(first, "rb").read()[:-1])
    with pytest.raises(CorruptError):  # not the last
        Store.open(spark, root, SMALL)


def test_commits_of_format_1_are_read(spark, tmp_path):
    import struct
    import zlib

    root = str(tmp_path / "s")
    Store.open(spark, root, SMALL).close()
    for seq, key in ((0, b"old"), (1, b"older")):
        body = struct.pack("<BII", 1, len(key), 1) + key + b"v"
        open(commits.path_of(root, seq), "wb").write(struct.pack("<4sHHIQI", b"VLOG", 1, 0, zlib.crc32(body), seq, 1) + body)
    with Store.open(spark, root, SMALL) as store:
        store.put(b"new", b"v")
    with Store.open(spark, root, SMALL) as store:
        assert [k for k, _ in store.scan()] == [b"new", b"old", b"older"]


def test_checkpoint_knows_the_streams(spark, tmp_path):
    rows = spark.range(3).selectExpr("id as op_index", "concat('k', id) as key", "'v' as value")
    with Store.open(spark, str(tmp_path / "s"), SMALL) as store:
        assert store.write_dataframe(rows, stream=("src", 4)) == 3
        store.checkpoint(str(tmp_path / "c"))
    with Store.open(spark, str(tmp_path / "c"), SMALL) as copy:
        assert copy.write_dataframe(rows, stream=("src", 4)) == 0 and copy.log().count() == 3


@pytest.fixture
def wide(spark, tmp_path):
    """A store with one segment of several files, a small one over it, and the paths that reads take."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    store = Store.open(spark, str(tmp_path / "s"), SMALL)
    rows = spark.range(4000).selectExpr("id as op_index", "concat('k', lpad(id, 5, '0')) as key", "case when id not between 1000 and 2900 then 'v' end as value")
    store.write_dataframe(rows)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    store.put(b"k00007", b"new")
    store.delete(b"k00008")
    store.flush_only()
    store.put(b"k00009", b"newest")
    frame, taken = store._frame, []
    store._frame = lambda paths, tail: taken.append([os.path.basename(p) for p in paths]) or frame(paths, tail)
    yield store, taken
    store.close()


def test_a_limited_scan_reads_few_files(spark, wide):
    store, taken = wide
    n_files = len(store._listed(store._manifest.segments[0]))
    assert n_files >= 3
    got = store.scan(b"k00005", None, 4)
    assert got == [(b"k00005", b"v"), (b"k00006", b"v"), (b"k00007", b"new"), (b"k00009", b"newest")]
    assert [len(p) for p in taken] == [2]  # one file of each segment
    taken.clear()
    far = store.scan(b"k01000", None, 2)  # over a range of deleted keys
    assert far == [(b"k02901", b"v"), (b"k02902", b"v")]
    assert store.scan(b"k03998", None, 100) == [(b"k03998", b"v"), (b"k03999", b"v")]
    assert store.scan(None, b"k00003", 100) == [(b"k0000%d" % i, b"v") for i in range(3)]


def test_lookups_read_the_files_that_may_hold_their_keys(spark, wide):
    store, taken = wide
    wanted = spark.createDataFrame([(b"k00001",), (b"k00008",), (b"none",), (None,), (b"k00001",)], "key binary")
    assert [(bytes(r.key), bytes(r.value)) for r in store.multi_get(wanted).collect()] == [(b"k00001", b"v")]
    assert len(taken[0]) == 2
    taken.clear()
    many = spark.range(1200).selectExpr("concat('k', lpad(id, 5, '0')) as key")
    assert store.multi_get(many).count() == 999
    assert len(taken[0]) < 1 + len(store._listed(store._manifest.segments[0]))
    taken.clear()
    assert store.get(b"k03999") == b"v" and store.get(b"k00008") is None and store.get(b"k00007") == b"new" and store.get(b"k0000") is None
    assert not taken  # no job
    assert store.multi_get(spark.createDataFrame([], "key binary")).collect() == []


def test_a_hot_key_over_several_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    with Store.open(spark, str(tmp_path / "s"), SMALL) as store:
        store.write_dataframe(spark.range(3000).selectExpr("id as op_index", "case when id % 100 = 0 then concat('k', id) else 'hot' end as key", "concat('v', id) as value"))
        assert len(store._listed(store._manifest.segments[0])) >= 3
        want = sorted([(b"hot", b"v2999"), *((b"k%d" % i, b"v%d" % i) for i in range(0, 3000, 100))])
        for limit in (1, 2, 5, 31, 200):
            assert store.scan(limit=limit) == want[:limit]
        assert store.get(b"hot") == b"v2999"
        with store.snapshot() as snap:
            store.put(b"hot", b"x")
            assert store.get_at(snap, b"hot") == b"v2999" and store.scan_at(snap, limit=1) == want[:1]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


WRITER = """
import sys
from pyspark.sql import SparkSession
from versionlog.plans.store import Options, Store

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
store = Store.open(spark, sys.argv[1], Options(flush_threshold_bytes=1 << 30, compaction_threshold=2))
i = 0
while True:
    store.put(b"item-%07d" % i, b"content %d" % (i * 7))
    i += 1
    if i % 150 == 0:
        store.flush_only()
        if i % 300 == 0:
            store.compact_step()
    print("done", i, flush=True)
"""


def test_a_killed_writer_loses_no_acknowledged_write(spark, tmp_path):
    import signal
    import subprocess
    import sys

    root = str(tmp_path / "s")
    for least in (400, 650):  # the second time over what the first left
        run = subprocess.Popen([sys.executable, "-c", WRITER, root], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True)
        done = 0
        for line in run.stdout:
            if line.startswith("done"):
                done = int(line.split()[1])
                if done >= least:
                    break
        run.send_signal(signal.SIGKILL)
        done = max([done, *(int(x.split()[1]) for x in run.stdout.read().splitlines() if x.startswith("done ") and len(x.split()) == 2)])
        run.wait()
        with Store.open(spark, root) as again:
            held = dict(again.scan())
            assert all(held[b"item-%07d" % i] == b"content %d" % (i * 7) for i in range(done)) and done >= least
            assert all(v == b"content %d" % (int(k[5:]) * 7) for k, v in held.items())
            again.flush()
            assert len(again.scan()) == len(held)


def test_point_reads_of_a_row_group():
    import pyarrow as pa

    from versionlog.sources.points import RowGroup

    rows = [(b"a", 5, b"x"), (b"a", 2, None), (b"b", 9, b""), *((b"hot", s, b"%d" % s) for s in range(999, 0, -1)), (b"z", 1, None)]
    columns = list(zip(*rows, strict=True))
    group = RowGroup(pa.table({"key": pa.array(columns[0], pa.binary()), "seq": pa.array(columns[1], pa.int64()), "value": pa.array(columns[2], pa.binary())}))
    for key in (b"", b"a", b"aa", b"b", b"hot", b"z", b"zz"):
        for bound in (None, 0, 1, 2, 3, 6, 500, 995, 1000):
            want = [(s, v) for k, s, v in rows if k == key and (bound is None or s < bound)]
            assert group.newest(key, bound) == (want[0] if want else None)
    assert RowGroup(pa.table({"key": pa.array([], pa.binary()), "seq": pa.array([], pa.int64()), "value": pa.array([], pa.binary())})).newest(b"a", None) is None


def test_the_cache_of_row_groups_is_bounded(spark, tmp_path):
    options = Options(sync_mode="none", cache_bytes=1)
    with Store.open(spark, str(tmp_path / "s"), options) as store:
        for i in range(5):
            store.put(b"k%d" % i, b"v%d" % i)
            store.flush_only()
        assert [store.get(b"k%d" % i) for i in range(5)] == [b"v%d" % i for i in range(5)]
        assert len(store._points._groups) == 1
