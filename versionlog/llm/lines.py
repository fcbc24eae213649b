"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A text is split at line feeds. Each line has a hash; a rolling hash over the last ``reach``
line hashes ends a chunk wherever it is divisible by ``every``, so boundaries depend on the
lines around them and not on their place in the text: an inserted or missing line moves no
boundary further on. Chunks of ``least_lines`` lines or more that occur more than once over
the whole table are removed, except for their first occurrence (smallest id, then smallest
place). Hashes only choose candidates: occurrences are removed after comparing bytes.

With ``windows`` every run of ``least_lines`` lines counts, not only whole chunks, so each
repeated passage of that many lines or more is removed up to its edges, wherever boundaries
would fall. A line's first occurrence is never lost: a run that holds it has not occurred before.

Null texts stay null, and a text that loses all its lines is empty. A null id comes after all
others. Rows equal in id and text are one occurrence and are treated alike. An empty table gives
an empty one. Texts are read whole; the work on a text is in proportion to its lines. Columns of
the input may have any name but those of ``details`` (pass none if they clash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versionlog.llm.common import cut

EVERY, REACH, LEAST_LINES = 3, 2, 2
#: A 32-bit value of each line is multiplied by this at each step of the rolling hash.
FACTOR = 31


def line_value(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks(text: Column, every: int, reach: int) -> Column:
    """Array of (at, lines): each chunk's first line number (from 0) and its lines."""

    def ends(of: Column) -> Column:
        """Numbers of the lines that end a chunk; the last line always does."""

        def rolled(i: Column) -> Column:
            out = F.lit(0).cast("long")
            for back in range(reach):  # a line before the first counts as zero
                value = F.when(i >= back, F.get(of, i - back)).otherwise(F.lit(0).cast("long"))
                out = out + value * F.lit(FACTOR**back)
            return out

        last = F.size(of) - 1
        return F.filter(F.sequence(F.lit(0), last), lambda i: (rolled(i) % every == 0) | (i == last))

    def cut_at(lines: Column, found: Column) -> Column:
        def one(end: Column, k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(found, k - 1) + 1)
            return F.struct(start.alias("at"), F.slice(lines, start + 1, end - start + 1).alias("lines"))

        return F.transform(found, one)

    # each intermediate array is bound once, so that it is not evaluated again for each use
    def of_lines(lines: Column) -> Column:
        values = F.array(F.transform(lines, line_value))
        return F.flatten(F.transform(F.transform(values, ends), lambda found: cut_at(lines, found)))

    return F.flatten(F.transform(F.array(F.split(text, "\n", -1)), of_lines))


def windows_of(text: Column, length: int) -> Column:
    """Array of (at, lines): every run of ``length`` lines."""

    def cut_at(lines: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: i + length <= F.size(lines))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice(lines, i + 1, length).alias("lines")))

    return F.flatten(F.transform(F.array(F.split(text, "\n", -1)), cut_at))  # split once


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    every: int = EVERY,
    reach: int = REACH,
    least_lines: int = LEAST_LINES,
    windows: bool = False,
    broadcast_rows: int = 1 << 20,
    details: tuple[str, str] | None = ("n_lines", "removed"),
) -> DataFrame:
    """``docs`` with the text replaced, and the two columns that ``details`` names.

    The first is the number of lines; the second lists (at, n): each removed chunk's first line
    number and its lines (with ``windows``, each removed run of lines).
    """
    if details and (clash := set(details) & set(docs.columns)):
        raise ValueError(f"the input has columns {sorted(clash)}; give other names in details")
    rows = docs.withColumns({"__id": F.col(f"`{id_col}`"), "__text": F.col(f"`{text_col}`")})
    rows = rows.withColumn("__th", F.xxhash64("__text"))
    found = windows_of(F.col("__text"), least_lines) if windows else chunks(F.col("__text"), every, reach)
    each = rows.select("__id", "__th", F.explode(found).alias("c")).where(F.size("c.lines") >= least_lines)
    # 1. chunks are formed once and written without their lines
    each = cut(
        each.select("__id", "__th", F.col("c.at").alias("at"), F.size("c.lines").alias("n"), F.xxhash64(F.array_join("c.lines", "\n")).alias("code"))
    )
    codes = cut(each.groupBy("code").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("code"))  # so that the join can split a common one
    hits = each.join(codes, "code", "left_semi")
    # 2. the lines of those whose hash occurs more than once, from the texts that hold any
    asked = cut(hits.groupBy(F.col("__id").alias("a_id"), F.col("__th").alias("a_th")).agg(F.collect_set(F.struct("at", "n", "code")).alias("asked")))
    held = asked.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()[0]  # texts and chunks, some 40 bytes each
    asked = F.broadcast(asked) if held <= broadcast_rows else asked.hint("shuffle_hash")
    held = rows.join(asked, rows["__id"].eqNullSafe(asked["a_id"]) & (rows["__th"] == asked["a_th"]))

    def with_lines(lines: Column) -> Column:  # the text is split once
        return F.transform("asked", lambda c: F.struct(c["at"].alias("at"), c["n"].alias("n"), c["code"].alias("code"), F.array_join(F.slice(lines, c["at"] + 1, c["n"]), "\n").alias("chunk")))

    spelled = F.flatten(F.transform(F.array(F.split("__text", "\n", -1)), with_lines))
    hits = cut(held.select("__id", "__th", F.explode(spelled).alias("c")).select("__id", "__th", "c.*"))
    # 3. the first occurrence of each distinct chunk, by its bytes
    place = F.struct(F.col("__id").isNull().alias("last"), "__id", "at", "__th")
    first = hits.groupBy("code", "chunk").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    first = cut(first)  # written, so that the join below can split a chunk with very many occurrences
    other = hits.join(first.select(F.col("code"), F.col("chunk").alias("same"), "first"), "code").where("chunk = same")
    other = other.where(~place.eqNullSafe(F.col("first")))
    # 4. texts without those chunks
    gone = other.groupBy(F.col("__id").alias("g_id"), F.col("__th").alias("g_th")).agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("gone"))
    if windows:  # they overlap
        gone = gone.withColumn("gone", merged("gone"))
    gone = gone.hint("shuffle_hash")
    joined = rows.join(gone, rows["__id"].eqNullSafe(gone["g_id"]) & (rows["__th"] == gone["g_th"]), "left")
    text = F.when(F.col("gone").isNull(), F.col("__text")).otherwise(F.array_join(without("__text", "gone"), "\n"))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if details:
        nothing = F.array().cast("array<struct<at:int,n:int>>")
        n_lines = F.when(F.col("__text").isNull(), 0).otherwise(F.size(F.split("__text", "\n", -1))).cast("long")
        columns += [n_lines.alias(details[0]), F.coalesce("gone", nothing).alias(details[1])]
    return joined.select(*columns)


def merged(runs: str) -> Column:
    """Sorted (at, n) that may overlap, as runs that do not: a run begins where none before it reaches."""
    numbers = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["at"], r["at"] + r["n"] - 1))))

    def of_numbers(all_: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: (i == 0) | (F.get(all_, i - 1) + 1 < F.get(all_, i)))

        def of_heads(begins: Column) -> Column:
            def one(head: Column, k: Column) -> Column:
                end = F.coalesce(F.get(begins, k + 1), F.size(all_))
                return F.struct(F.get(all_, head).alias("at"), (end - head).alias("n"))

            return F.transform(begins, one)

        return F.flatten(F.transform(F.array(heads), of_heads))

    return F.flatten(F.transform(F.array(numbers), of_numbers))


def without(text: str, runs: str) -> Column:
    """The lines of a text but for sorted runs that do not overlap: the slices between them."""

    def of_lines(lines: Column) -> Column:
        def one(i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["at"] + F.get(runs, i - 1)["n"])
            end = F.coalesce(F.get(runs, i)["at"], F.size(lines))
            return F.slice(lines, begin + 1, end - begin)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), one))

    return F.flatten(F.transform(F.array(F.split(text, "\n", -1)), of_lines))


def digest(found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of the registered query."""
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["n"])
    return found.select(
        F.col(f"`{id_col}`"),
        "n_lines",
        F.size("removed").cast("long").alias("n_chunks_removed"),
        n.alias("n_lines_removed"),
        F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("kept_sha256"),
    )


#: DuckDB SQL for the registered query, from the same fixed values.
ORACLE = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (
    SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i, len(lines) AS n FROM d WHERE text IS NOT NULL
), v AS (
    SELECT doc_id, line, i, n, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS v FROM l
), r AS (
    SELECT doc_id, line, i, n, v + {FACTOR} * coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY i), 0) AS r FROM v
), c AS (
    SELECT doc_id, line, i,
           coalesce(sum(CASE WHEN r % {EVERY} = 0 THEN 1 ELSE 0 END) OVER (
               PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_no
    FROM r
), k AS (
    SELECT doc_id, min(i) AS head, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY doc_id, chunk_no
), o AS (
    SELECT doc_id, head, n, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, head) AS nth FROM k WHERE n >= {LEAST_LINES}
), g AS (
    SELECT doc_id, head, n FROM o WHERE nth > 1
), t AS (
    SELECT l.doc_id, l.line, l.i, g.head IS NOT NULL AS gone
    FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i >= g.head AND l.i < g.head + g.n
), x AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS lines_gone FROM t GROUP BY doc_id
), m AS (SELECT doc_id, count(*) AS chunks_gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(m.chunks_gone, 0) AS BIGINT) AS n_chunks_removed,
       CAST(coalesce(x.lines_gone, 0) AS BIGINT) AS n_lines_removed,
       sha256(coalesce(x.kept, '')) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
