"""Words that tell toxic texts, by their Kneser-Ney continuation counts.

Words are runs of ASCII letters or digits and of all code points from U+0080, with A-Z
lower-cased. A unigram of a Kneser-Ney model counts the distinct words a word follows, not its
occurrences. Here each such pair belongs to the smallest id of the toxic texts that hold it, and
a word counts its pairs' owners: a copy of a text owns only what was changed in it, so a text
with many copies counts about once. A word is marked if the Wilson lower bound of
owners / (owners + clean texts with the word) reaches ``share``, which takes at least 35 owners
at 0.9. With fewer toxic texts nothing is marked, whatever they say.

Labels are 1 (toxic) and 0 (clean), and a document labelled both ways is toxic. Words are learned
from at most ``most_labels`` documents of either kind, those whose ids hash smallest; all
documents are judged by them. Null and empty texts have no words. Null ids have no label, but
their texts are judged. Rows that repeat are judged alike. Very long texts are read whole. An
empty table of documents or labels, and labels without the column, mark nothing; other columns
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versionlog.llm.common import cut, pick

#: Two-sided 95 %.
_Z = 1.96


def words_of(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def lower_bound(hits: Column, others: Column) -> Column:
    """Wilson's lower bound of the share of ``hits``."""
    n = (hits + others).cast("double")
    p, zz = hits / n, _Z * _Z
    return (p + zz / (2 * n) - _Z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def _held(words: DataFrame, broadcast_bytes: int) -> tuple[int, DataFrame]:
    """How many words there are, and the side of a join: sent to all tasks only if small."""
    row = words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("word") + 64), F.lit(0)).alias("size")).first()
    return row["n"], F.broadcast(words) if row["size"] <= broadcast_bytes else words.hint("shuffle_hash")


def lexicon(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    share: float = 0.9,
    most_labels: int = 1 << 18,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """(word, owners, clean) of the words that tell toxic texts."""
    known = pick(labels, __t=id_col, label=label_col).where("__t is not null and label in (0, 1)")
    known = known.groupBy("__t").agg(F.max("label").alias("label"))

    def texts(label: int) -> DataFrame:
        ids = known.where(F.col("label") == label).orderBy(F.xxhash64("__t"), "__t").limit(most_labels).select("__t")
        rows = pick(docs, id=id_col, text=text_col)
        return rows.join(F.broadcast(ids), F.col("id") == F.col("__t"), "left_semi")  # at most most_labels ids

    words = texts(1).select("id", words_of(F.col("text")).alias("words"))
    pairs = words.select("id", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), "words").alias("prev"), F.col("words").alias("word"))).alias("p"))
    pairs = pairs.select("id", "p.prev", "p.word").where("word is not null")
    owners = pairs.groupBy("prev", "word").agg(F.min("id").alias("id")).groupBy("word").agg(F.countDistinct("id").alias("owners"))
    likely = cut(owners.where(lower_bound(F.col("owners"), F.lit(0)) >= share))
    n, side = _held(likely.select("word"), broadcast_bytes)
    if not n:
        return likely.withColumn("clean", F.lit(0).cast("long"))
    clean = texts(0).select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    clean = clean.join(side, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("clean"))
    found = likely.join(clean, "word", "left").select("word", "owners", F.coalesce("clean", F.lit(0)).alias("clean"))
    return cut(found.where(lower_bound(F.col("owners"), F.col("clean")) >= share))


def holders(
    docs: DataFrame, words: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 32 << 20
) -> DataFrame | None:
    """Distinct (id, th) of the documents that hold one of ``words``; th is the XXH64 of the text. None if there are no words."""
    n, side = _held(words.select("word"), broadcast_bytes)
    if not n:
        return None
    rows = pick(docs, id=id_col, text=text_col)
    rows = rows.select("id", F.xxhash64("text").alias("th"), F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    return rows.join(side, "word", "left_semi").select("id", "th").distinct()
