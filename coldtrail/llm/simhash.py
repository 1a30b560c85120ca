"""SimHash near-dedup through one-wildcard segment variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldtrail.llm.common import chunks, row_hash, rows_of, split_words, whole_text
from coldtrail.llm.components import components
from coldtrail.sources.workspace import stored

SEED = 42
BITS = 2  # largest bit distance of a link; the two-segment index below rests on it
PAIRED = 32  # buckets up to this many fingerprints are joined to pairs; larger ones take the neighbour index


def fingerprints(text: pa.Array, width: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text: bits set in over half of its shingles' hashes; zero without words."""
    words, offsets = split_words(text, lower=True)
    counts = np.diff(offsets)
    joined = pa.concat_arrays([words.cast(pa.binary())]) if len(words) else pa.array([], pa.binary())
    lengths = pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64) if len(joined) else np.zeros(0, np.int64)
    stops = np.cumsum(lengths + 1) - 1  # in the words joined by single blanks
    begins = stops - lengths
    line = b" ".join(joined.to_pylist())
    shingles = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    starts = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(shingles)[:-1]]), shingles) + np.arange(shingles.sum())
    last = np.minimum(starts + width, np.repeat(offsets[1:], shingles)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(begins[starts].tolist(), stops[last].tolist())), np.uint64, len(starts))
    result = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(shingles)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.concatenate([[0], np.cumsum(shingles[full])[:-1]])
        most = np.add.reduceat(bits, first, axis=0, dtype=np.int64) * 2 > shingles[full][:, None]
        result[full] = np.packbits(most, axis=1, bitorder="little").view(np.uint64).ravel()
    return result


def with_fingerprint(docs: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """(doc_id, row, fp): hashes of the rows, and fingerprints as signed 64-bit numbers."""
    ids = docs.select(F.col(id_column).alias("doc_id"), row_hash(docs).alias("row"), whole_text(text_column).alias("text"))
    kind = ids.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fingerprints(part.column(2), width).view(np.int64))], ["doc_id", "row", "fp"])

    return ids.mapInArrow(run, f"doc_id {kind}, row bigint, fp bigint")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _half(fp: Column, upper: bool) -> Column:
    return F.shiftrightunsigned(fp, 32) if upper else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _variants(prints: DataFrame) -> DataFrame:
    """(key, fp), 34 keys each. Of two segments of 32 bits, one is equal or both differ by one bit, for prints within two
    bits: either segment as it is, and the upper one with each bit replaced by a wildcard. The key is the segment's 32
    bits beside the number of the variant."""
    upper, lower = _half(F.col("fp"), True), _half(F.col("fp"), False)
    wild = [upper.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))) + F.lit((bit + 2) << 32) for bit in range(32)]
    keys = F.array(upper, lower + F.lit(1 << 32), *wild)
    return prints.select("fp", F.explode(keys).alias("key"))


def _neighbour_links(prints: DataFrame) -> DataFrame:
    """Links among prints that share very large buckets: two prints lie within two bits exactly when some point lies
    within one bit of both. A point has at most 65 prints, so its group is bounded and no pair is lost."""
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << bit) - (1 << 64) if bit == 63 else 1 << bit).cast("bigint")) for bit in range(64)])
    near = prints.select("fp", F.explode(points).alias("point"))
    shared = near.groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return shared.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b").select("a", "b")


def links_within_two_bits(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most two bits apart: enough of them to connect every such pair."""
    keyed = _variants(prints)
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    buckets = stored(buckets, "buckets")
    two = buckets.where("n = 2").select("a", "b").where(_distance("a", "b") <= BITS)
    members = stored(keyed.join(buckets.where("n > 2").select("key", "n"), "key"), "bucket-members")
    small = members.where(F.col("n") <= paired)
    few = small.select("key", F.col("fp").alias("a")).join(small.select("key", F.col("fp").alias("b")), "key").where("a > b").where(_distance("a", "b") <= BITS)
    many = _neighbour_links(members.where(F.col("n") > paired).select("fp").distinct())
    return two.unionByName(few.select("a", "b")).unionByName(many).distinct()


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, paired: int = PAIRED) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links of at
    most two differing bits).

    Texts lose A-Z for a-z; shingles are ``width`` words with repeats (fewer words: the whole sequence). A text without
    words, empty or null has fingerprint zero and links like any other. Repeated rows come back as often; a null id is
    never a component id unless its component has no other. Other columns are ignored; no rows give no rows.

    Work runs on distinct fingerprints: copies count once. Their variants meet by equality join. A bucket of up to
    ``paired`` prints is verified pair by pair, a larger one through common one-bit neighbours, which finds the same
    connections in linear space.
    """
    prints = stored(with_fingerprint(docs, id_column, text_column, width), "fingerprints")
    placed = _placed(prints, paired)
    named = stored(placed.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    ids = stored(placed.join(named, "root").select("fp", "component_id"), "component-of-fingerprint")
    return prints.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _placed(prints: DataFrame, paired: int) -> DataFrame:
    """(fp, least, root): each fingerprint once, with its smallest id and the least fingerprint it reaches."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links_within_two_bits(distinct.select("fp"), paired))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return stored(placed, "placed-fingerprints")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, paired: int = PAIRED) -> DataFrame:
    """One row of each component, with all its columns: the smallest id (a null id last), then the smallest fingerprint and
    hash of the row. No other row goes: rows that share an id, or have none, stay where their components differ."""
    prints = stored(with_fingerprint(docs, id_column, text_column, width), "fingerprints")
    roots = _placed(prints, paired).select("fp", "root")
    equal = prints.groupBy("fp", "doc_id", "row").agg(F.count("*").alias("times")).join(roots, "fp")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "row", "times")).alias("best")
    return rows_of(docs, equal.groupBy("root").agg(best).select("best.doc_id", "best.row", "best.times"), id_column)
