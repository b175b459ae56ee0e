"""Exact deduplication by content hash, with bytes compared inside groups.

Hash and text together are the grouping key, so that texts are equal only when
their bytes are. Equal texts of one map task are folded before they move: a
group with a third of all rows costs one text per map task. Documents then meet
their group through narrow rows (id and digests) by the hash alone, except for
hashes that two different texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.common import stored, table
from graftwork.llm.registry import query

LARGEST, SMALLEST = "largest", "smallest"


def content_hash(text: Column) -> Column:
    """128-bit content hash of a text."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = SMALLEST
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their UTF-8 bytes are equal; null counts as the empty
    text. ``keep`` says whether the smallest or largest id of a group stays.
    Rows that repeat an id are counted, and are kept together. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    best = F.max if keep == LARGEST else F.min
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    texts = texts.withColumn("h", content_hash(F.col("body")))
    rows = stored(texts.select("id", "h", F.sha2(F.col("body"), 256).alias("sha")), "digests")
    # Bytes are compared here: the text itself is a grouping key.
    by_text = texts.groupBy("h", "body").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = stored(by_text.select("h", "keep_id", "n"), "groups")
    collided = stored(
        groups.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("h"), "collided"
    )
    by_hash = rows.join(collided, "h", "left_anti").join(groups, "h")
    split = texts.join(collided, "h", "left_semi")
    compared = split.groupBy("h", "body").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    by_bytes = (
        split.join(compared, ["h", "body"])
        .select("h", "id", F.sha2(F.col("body"), 256).alias("sha"), "keep_id", "n")
    )
    found = by_hash.select("h", "id", "sha", "keep_id", "n").unionByName(by_bytes)
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = SMALLEST
) -> DataFrame:
    """One row of every text, with all its columns; decided by id and content, so ids may repeat or be null."""
    groups = exact_groups(df, id_col, text_col, keep)
    found = stored(groups.select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__text"), "kept"), "kept")
    gone = found.filter(~F.col("kept")).distinct()
    repeated = found.filter("kept").groupBy("__id", "__text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = df.withColumn("__sha", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))

    def same(other: DataFrame) -> Column:
        return F.col(id_col).eqNullSafe(other["__id"]) & (F.col("__sha") == other["__text"])

    left = rows.join(gone, same(gone), "left_anti")
    repeated = stored(repeated.select("__id", "__text"), "repeated")
    if not repeated.isEmpty():
        again = left.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, "__sha"])
        left = left.join(repeated, same(repeated), "left_anti").unionByName(again)
    return left.drop("__sha")


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


@query("op10_exact_dedup", sql=OP10_SQL)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep=LARGEST)
