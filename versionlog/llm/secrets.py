"""Secret scans with an incremental blob ledger.

Every text is a blob named by its SHA-256. A ledger holds each (blob, rule version) that has
been scanned, with its findings. A run names all blobs, scans only the pairs the ledger
lacks, adds them to it, and joins the findings back to every path that holds the blob.

Base kinds (leftmost, non-overlapping matches of each kind; too short ones are dropped):

* ``assign``  a value of 12 or more characters assigned to a name such as ``password``
* ``access``  an access key id of 18 or more characters
* ``hex``     a run of 16 or more lowercase hex digits

Kinds that the method adds: ``private_key`` (PEM block), ``jwt`` and ``token`` (prefixed
service tokens). Spans are in code points, end exclusive.

A null text is the empty blob. Equal texts are one blob, however many rows hold them; each
row has its own result. Rows with a null id are kept; rows that repeat in whole have a result
each. An empty table has no result and adds nothing to the ledger. Texts of any length are
scanned whole, in time in proportion to their length. Other columns are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlog.llm.common import cut

# The base patterns and least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "private_key", "jwt", "token")
BASE = KINDS[:3]
_NAMES = ("passw", "secret", "token", "api")
#: Of each kind that is added the marks, one of which every match holds.
_MARKS = {"private_key": ("-----BEGIN",), "jwt": (".eyJ",), "token": ("_", "xox")}
_KEY_HEAD, _KEY_TAIL = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
#: A signed web token is three runs of these characters with a dot between, the first two from "eyJ" on.
_RUN, _HEAD, _HEAD_LEAST, _LAST_LEAST = re.compile(r"[A-Za-z0-9_-]+"), "eyJ", 11, 8
_TOKEN = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}")
#: Changes whenever a pattern, flag, mark, length, kind or the order of kinds does, so the ledger
#: never mixes rules. The last number stands for the code around them: raise it with a change there.
RULE_VERSION = hashlib.sha256(
    repr(
        [(p.pattern, p.flags) for p in (ASSIGN, ACCESS, _KEY_HEAD, _KEY_TAIL, _RUN, _TOKEN)]
        + ["[0-9a-f]+", ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, KINDS, _NAMES, _MARKS, _HEAD, _HEAD_LEAST, _LAST_LEAST, 2]
    ).encode()
).hexdigest()[:16]

_HEX = np.zeros(257, dtype=np.int8)
_HEX[48:58] = _HEX[97:103] = 1


def hex_runs(data: np.ndarray) -> np.ndarray:
    """(start, end) in bytes of the runs of HEX_LEAST or more lowercase hex digits."""
    # a long run covers a whole aligned block of half its least length
    half = HEX_LEAST // 2
    flags = _HEX[data]
    blocks = flags[: len(flags) // half * half].reshape(-1, half)
    if not len(blocks) or not (blocks.sum(axis=1) == half).any():
        return np.zeros((0, 2), dtype=np.int64)
    steps = np.diff(flags, prepend=0, append=0)
    runs = np.stack([np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)], axis=1)
    return runs[runs[:, 1] - runs[:, 0] >= HEX_LEAST]


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets in code points of offsets in UTF-8 bytes."""
    begins = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    return begins[at]


def private_keys(text: str) -> list[tuple[int, int]]:
    """From each head to the first tail after it; both are found once, so heads without a tail cost nothing more."""
    tails = [m.span() for m in _KEY_TAIL.finditer(text)]
    found, k, done = [], 0, 0
    for head in _KEY_HEAD.finditer(text):
        if head.start() < done:
            continue
        while k < len(tails) and tails[k][0] < head.end():
            k += 1
        if k == len(tails):
            break
        done = tails[k][1]
        found.append((head.start(), done))
    return found


def web_tokens(text: str) -> list[tuple[int, int]]:
    """Three neighbouring runs each; every run is read once."""
    runs = [m.span() for m in _RUN.finditer(text)]
    found, i = [], 0
    while i + 2 < len(runs):
        (a, b), (c, d), (e, f) = runs[i : i + 3]
        if c == b + 1 and e == d + 1 and text[b] == text[d] == "." and d - c >= _HEAD_LEAST and f - e >= _LAST_LEAST and text.startswith(_HEAD, c):
            start = text.find(_HEAD, a, b)
            if start != -1 and b - start >= _HEAD_LEAST:
                found.append((start, f))
                i += 3
                continue
        i += 1
    return found


_ADDED = {"private_key": private_keys, "jwt": web_tokens, "token": lambda text: [m.span() for m in _TOKEN.finditer(text)]}


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text, by start and then by kind as listed."""
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    runs = hex_runs(data)
    if len(runs):
        found += [("hex", a, b) for a, b in (code_points(data, runs) if len(data) != len(text) else runs).tolist()]
    for kind, search in _ADDED.items():
        if any(mark in text for mark in _MARKS[kind]):
            found += [(kind, *span) for span in search(text)]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return found


_FINDINGS = "array<struct<kind:string,start:long,end:long>>"


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    ledger: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings of every row, ledger entries of this run).

    The first has the id, ``blob`` and ``findings``; the second has ``blob``,
    ``rule_version`` and ``findings`` of the pairs scanned now, to be appended to ``ledger``
    (which has the same columns, and may hold a pair twice after a retried or concurrent
    append). See ``scan_with_ledger`` for a stored ledger.
    """
    named = docs.select(
        F.col(f"`{id_col}`").alias("__id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"),
    ).withColumn("blob", F.unhex(F.sha2("__text", 256)))
    paths = cut(named.select("__id", "blob"))
    todo = paths.groupBy("blob").agg(F.min("__id").alias("__first"))
    if ledger is not None:
        done = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob")
        todo = todo.join(done, "blob", "left_anti")  # an entry that is there twice does no harm
    # One row of each blob not yet scanned: the small side is hashed, texts are not sorted.
    todo = todo.select(F.col("blob").alias("__b"), "__first").hint("shuffle_hash")
    fresh = named.join(todo, F.col("__id").eqNullSafe(F.col("__first")) & (F.col("blob") == F.col("__b")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan_text(t.as_py())] for t in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(spans, type=kind)], names=["blob", "findings"])

    scanned = fresh.select("blob", "__text").mapInArrow(run, f"blob binary, findings {_FINDINGS}")
    # Rows that repeat in whole (same id and text) are scanned alike; one entry stays.
    entries = cut(scanned.groupBy("blob").agg(F.first("findings").alias("findings"))).select(
        "blob", F.lit(RULE_VERSION).alias("rule_version"), "findings"
    )
    known = entries
    if ledger is not None:
        known = entries.unionByName(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob", "rule_version", "findings"))
    # one row for each blob (entries of one pair are equal); written, so that the join below can split a blob with very many paths
    hits = cut(known.where(F.size("findings") > 0).groupBy("blob").agg(F.first("findings").alias("findings")))
    rows = paths.join(hits, "blob", "left").select(
        F.col("__id").alias(id_col), "blob", F.coalesce("findings", F.array().cast(_FINDINGS)).alias("findings")
    )
    return rows, entries


def scan_with_ledger(docs: DataFrame, ledger_path: str, **names: str) -> DataFrame:
    """Scan against a ledger stored as Parquet, and append to it what was scanned now."""
    spark = docs.sparkSession
    schema = f"blob binary, rule_version string, findings {_FINDINGS}"
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    ledger = cut(spark.read.schema(schema).parquet(ledger_path)) if there else None
    rows, entries = scan(docs, ledger=ledger, **names)
    entries.write.mode("append").parquet(ledger_path)
    return rows


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the registered query."""

    def count(kind: str) -> F.Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))
    return rows.select(
        F.col(f"`{id_col}`"), *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans")
    )
