"""Query catalog: the engine's operators over the version log of ``events``, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.functions.versions import encoded_size, size_tier
from versionlog.operators import retention, visible

COLS = {"key": "k", "seq": "seq", "value": "v"}
SEGMENT_ROWS, BATCH_ROWS = 1250, 100


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions (k, seq, v): an event of type ``error`` deletes its user's key."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("k"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("v"),
        F.col("event_id").alias("seq"),
    )


def with_segments(log: DataFrame) -> DataFrame:
    return log.withColumn("seg", F.floor(F.col("seq") / SEGMENT_ROWS).cast("long"))


Query = Callable[[SparkSession, str], DataFrame]
_LOG = """log AS (
    SELECT concat('u', lpad(CAST(user_id AS VARCHAR), 5, '0')) AS k,
           CASE WHEN event_type <> 'error' THEN props END AS v, event_id AS seq FROM events)"""


def _live_sql(bound: int | None = None, where: str = "TRUE") -> str:
    below = "TRUE" if bound is None else f"seq < {bound}"
    return f"""SELECT k, v FROM (
        SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log WHERE {below} AND {where}
    ) t WHERE rn = 1 AND v IS NOT NULL"""


def _compact_sql(first: int | None, end: int | None, horizon: int | None, drop: bool) -> str:
    h = (1 << 63) - 1 if horizon is None else horizon
    inside = "TRUE" if first is None else f"seg >= {first} AND seg < {end}"
    return f"""SELECT k, seq, v FROM (
        SELECT k, seq, v, max(CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END) OVER (
            PARTITION BY k ORDER BY seq DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS has_live
        FROM (SELECT k, seq, v, row_number() OVER (PARTITION BY k, seq < {h} ORDER BY seq DESC) AS rn
              FROM (SELECT k, v, seq, CAST(floor(seq / {SEGMENT_ROWS}.0) AS BIGINT) AS seg FROM log) s WHERE {inside}) a
        WHERE seq >= {h} OR rn = 1) b {"WHERE has_live = 1" if drop else ""}"""


def _scan(start: str | None = None, end: str | None = None, limit: int | None = None, bound: int | None = None) -> tuple[Query, str]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return visible.scan(event_log(spark, sf_dir), start, end, limit, bound, **COLS)

    tests = [f"k >= '{start}'"] * (start is not None) + [f"k < '{end}'"] * (end is not None)
    sql = _live_sql(bound, " AND ".join(tests) or "TRUE")
    return query, sql + (f" ORDER BY k LIMIT {limit}" if limit is not None else "")


def _get(key: str, bound: int | None = None) -> tuple[Query, str]:
    return lambda spark, sf_dir: visible.get(event_log(spark, sf_dir), key, bound, **COLS), _live_sql(bound, f"k = '{key}'")


def _compact(first: int | None, end: int | None, horizon: int | None, drop: bool) -> tuple[Query, str]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = with_segments(event_log(spark, sf_dir))
        if first is not None:
            log = log.where((F.col("seg") >= first) & (F.col("seg") < end))
        return retention.retained(log.drop("seg"), horizon, drop, **COLS).select("k", "seq", "v")

    return query, _compact_sql(first, end, horizon, drop)


KEYS = ("u00003", "u00042", "u00077", "u99999")


def _multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(k,) for k in KEYS], "wanted string")
    return visible.multi_get(event_log(spark, sf_dir), wanted, **COLS)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = with_segments(event_log(spark, sf_dir))
    return log.groupBy("seg").agg(F.sum(encoded_size(F.col("k"), F.col("v"))).cast("long").alias("bytes"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.segment_stats(with_segments(event_log(spark, sf_dir)), **COLS)


def _as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each customer's user key just before each of that user's error events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == "error")
    probes = events.select(F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("k"), F.col("event_id").alias("bound"))
    return visible.as_of(event_log(spark, sf_dir), probes, **COLS)


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operation that wins on each key of each batch of the log."""
    of = F.struct(F.floor(F.col("seq") / BATCH_ROWS).cast("long").alias("batch"), "k")
    won = visible.latest(event_log(spark, sf_dir).withColumn("of", of), key="of", seq="seq", value="v")
    return won.select("of.batch", "of.k", "seq", "v")


_SIZES_SQL = f"""SELECT seg, CAST(sum(17 + length(k) + coalesce(length(v), 0)) AS BIGINT) AS bytes
    FROM (SELECT k, v, seq, CAST(floor(seq / {SEGMENT_ROWS}.0) AS BIGINT) AS seg FROM log) s GROUP BY seg"""

_ALL: dict[str, tuple[Query, str]] = {
    "kv_live_view": (lambda s, d: visible.live(event_log(s, d), **COLS), _live_sql()),
    "kv_get_hit": _get("u00042"),
    "kv_get_absent": _get("u99999"),
    "kv_multi_get": (_multi_get, _live_sql(None, f"k IN {KEYS}")),
    "kv_get_at": _get("u00042", 5000),
    "kv_scan_half_open": _scan("u00010", "u00050"),
    "kv_scan_start_only": _scan("u00100"),
    "kv_scan_end_only": _scan(None, "u00020"),
    "kv_scan_limit": _scan("u00010", None, 10),
    "kv_scan_limit_zero": _scan("u00010", None, 0),
    "kv_scan_inverted_range": _scan("u00050", "u00010"),
    "kv_scan_at": _scan("u00010", "u00050", 25, 5000),
    "kv_tombstoned_keys": (
        lambda s, d: visible.latest(event_log(s, d), **COLS).where("v is null").select("k", "seq"),
        "SELECT k, seq FROM (SELECT k, v, seq, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) t WHERE rn = 1 AND v IS NULL",
    ),
    "kv_version_history": (
        lambda s, d: visible.versions_of(event_log(s, d), "u00042", key="k", seq="seq").select("k", "seq", "v"),
        "SELECT k, seq, v FROM log WHERE k = 'u00042'",
    ),
    "kv_full_iteration": (
        lambda s, d: visible.every_version(event_log(s, d), key="k", seq="seq").select("k", "seq", "v"),
        "SELECT k, seq, v FROM log",
    ),
    "kv_batch_last_wins": (
        _batches,
        f"""SELECT batch, k, seq, v FROM (SELECT CAST(floor(seq / {BATCH_ROWS}.0) AS BIGINT) AS batch, k, v, seq,
            row_number() OVER (PARTITION BY floor(seq / {BATCH_ROWS}.0), k ORDER BY seq DESC) AS rn FROM log) t WHERE rn = 1""",
    ),
    "kv_flush_segments": (
        _stats,
        f"""SELECT seg, count(*) AS record_count, min(k) AS min_key, max(k) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq,
            CAST(sum(17 + length(k) + coalesce(length(v), 0)) AS BIGINT) AS bytes, count(*) FILTER (v IS NULL) AS tombstones
            FROM (SELECT k, v, seq, CAST(floor(seq / {SEGMENT_ROWS}.0) AS BIGINT) AS seg FROM log) s GROUP BY seg""",
    ),
    "kv_size_tiers": (
        lambda s, d: _sizes(s, d).select("seg", size_tier(F.col("bytes")).cast("long").alias("tier")),
        f"SELECT seg, CAST(length(bin(bytes)) AS BIGINT) AS tier FROM ({_SIZES_SQL}) z",
    ),
    "kv_pick_compaction": (
        lambda s, d: retention.merge_run(_sizes(s, d)),
        f"""SELECT min(seg) AS start_seg, max(seg) + 1 AS end_seg FROM (
            SELECT seg, tier, seg - row_number() OVER (PARTITION BY tier ORDER BY seg) AS island
            FROM (SELECT seg, length(bin(bytes)) AS tier FROM ({_SIZES_SQL}) z) a) b
            GROUP BY tier, island HAVING count(*) >= 4 ORDER BY start_seg LIMIT 1""",
    ),
    "kv_compact_full": _compact(None, None, None, True),
    "kv_compact_full_snapshot": _compact(None, None, 5000, True),
    "kv_compact_partial": _compact(2, 6, None, False),
    "kv_compact_partial_snapshot": _compact(2, 6, 5000, False),
    "kv_as_of": (
        _as_of,
        """SELECT p.k, p.bound, (SELECT max(struct_pack(seq := l.seq, v := l.v)) FROM log l WHERE l.k = p.k AND l.seq < p.bound).v AS v
           FROM (SELECT DISTINCT k, seq AS bound FROM log WHERE v IS NULL) p""",
    ),
    "kv_snapshot_diff": (
        lambda s, d: visible.changes(event_log(s, d), 5000, **COLS),
        f"""SELECT coalesce(a.k, b.k) AS k, a.v AS "before", b.v AS "after"
            FROM ({_live_sql(5000)}) a FULL OUTER JOIN ({_live_sql()}) b ON a.k = b.k
            WHERE a.v IS DISTINCT FROM b.v""",
    ),
}

QUERIES: dict[str, Query] = {name: query for name, (query, _) in _ALL.items()}
ORACLES: dict[str, str] = {name: f"WITH {_LOG} {sql}" for name, (_, sql) in _ALL.items()}
