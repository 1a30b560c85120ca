"""Helpers shared by the operators: words, chunks, the hold-out split, table reading."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldtrail.sources.workspace import stored

BLANKS = " \t\n\u000b\f\r"  # the characters of [\x20\x09-\x0D]
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def without_blanks(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text (one row at least), so that memory does not follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def split_words(text: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts in order, and where each text's words begin (one entry more than texts)."""
    text = pc.fill_null(text.cast(pa.string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    words, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full).as_py():
        kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        words, offsets = words.filter(full), kept[offsets]
    return words, offsets


def passages(text: Column, most: int, count: int = 16) -> Column:
    """A text of at most ``most`` code points as it is; of a longer one ``count`` passages at even distances, together that long,
    one to a line. For fitting on a bounded sample only."""
    size, part = F.length(text), most // count
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.substring(text, (F.floor(i * (size - part) / (count - 1)) + 1).cast("int"), F.lit(part)))
    return F.when(size <= most, text).otherwise(F.array_join(spread, "\n"))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the frame has it."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def row_hash(docs: DataFrame) -> Column:
    """64 bits of all columns of a row (maps aside): rows of one id and one hash are equal."""
    parts = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*parts)


def rows_of(docs: DataFrame, chosen: DataFrame, id_column: str) -> DataFrame:
    """The rows of ``docs`` named by ``chosen`` (id, hash, times: how many equal rows there are), one for each of its rows."""
    name = free_name(docs, "_hash")
    hashed = docs.withColumn(name, row_hash(docs))
    chosen = stored(chosen.toDF("_chosen_id", "_chosen_hash", "_times"), "chosen-rows")

    def named(rows: DataFrame) -> DataFrame:
        return hashed.join(rows, hashed[id_column].eqNullSafe(rows["_chosen_id"]) & (hashed[name] == rows["_chosen_hash"]), "left_semi")

    twins = chosen.where("_times > 1")
    once = named(chosen.where("_times = 1")).drop(name)
    if twins.isEmpty():
        return once
    return once.unionByName(named(twins).dropDuplicates([id_column, name]).drop(name))
