"""Exact dedup by 128-bit content hash, with the bytes compared inside equal hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldtrail.llm.common import row_hash, rows_of, whole_text, without_blanks
from coldtrail.operators.sized import small_side
from coldtrail.sources.workspace import stored


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", content_hash=F.md5) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty. Of equal texts the
    one with the most code points stays, then the smallest id (a null id comes last). Rows repeated with the same id
    count each in group_size and share ``kept``; an empty table gives an empty result; other columns are ignored.

    The groups come from a 128-bit ``content_hash``. Bytes are compared, by a distinct over (hash, text), where a hash has
    several rows: a hash with two texts is a collision, and its rows are grouped by hash and text. Copies collapse in the
    map task before each shuffle, and the group table is stored, so that a hot group joins back under AQE's skew split.
    """
    rows = _keyed(docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text")), content_hash)
    best: Column = F.min(F.struct((-F.col("length")).alias("n"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id")))
    groups = stored(rows.groupBy("key").agg(F.count("*").alias("group_size"), best.alias("best")).select("key", "group_size", F.col("best.id").alias("keep_id")), "exact-groups")
    return rows.join(groups, "key").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _keyed(rows: DataFrame, content_hash) -> DataFrame:
    """(doc_id, length, key, text_sha256, ...) of (doc_id, text, ...): equal keys for equal texts, and only for those.

    The key is the content hash. Bytes are compared only where a hash has several rows: two texts under one hash are a
    collision, and their rows take the text into the key. Hashes and lengths are stored once."""
    rest = [c for c in rows.columns if c not in ("doc_id", "text")]
    body = without_blanks(F.col("text"))
    hashed = rows.select("doc_id", "text", *rest, F.length("text").alias("length"), body.alias("body")).select(
        "doc_id", "text", *rest, "length", content_hash("body").alias("hash"), F.sha2("body", 256).alias("text_sha256"))
    digests = stored(hashed.select("doc_id", *rest, "length", "hash", "text_sha256"), "text-digests")
    several = stored(digests.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "repeated-hashes")
    texts = rows.select(body.alias("body")).select(content_hash("body").alias("hash"), "body")
    shared = texts.join(small_side(several), "hash", "left_semi").distinct()  # copies collapse before the shuffle
    collided = stored(shared.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "collisions")
    if collided.isEmpty():
        return digests.withColumnRenamed("hash", "key")
    flagged = hashed.join(collided.withColumn("clash", F.lit(True)), "hash", "left")
    return flagged.select("doc_id", *rest, "length", F.when(F.col("clash"), F.concat("hash", F.lit(":"), without_blanks(F.col("text")))).otherwise(F.col("hash")).alias("key"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", content_hash=F.md5) -> DataFrame:
    """One row of each group of equal texts, with all its columns: the most code points, then the smallest id (a null id
    last), then the smallest hash of the row. No other row goes: rows that share an id, or have none, stay as long as
    their texts differ."""
    rows = _keyed(docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"), row_hash(docs).alias("row")), content_hash)
    equal = rows.groupBy("key", "length", "doc_id", "row").agg(F.count("*").alias("times"))
    best = F.min(F.struct((-F.col("length")).alias("n"), F.col("doc_id").isNull().alias("last"), "doc_id", "row", "times")).alias("best")
    return rows_of(docs, equal.groupBy("key").agg(best).select("best.doc_id", "best.row", "best.times"), id_column)
