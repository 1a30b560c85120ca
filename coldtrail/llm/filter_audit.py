"""Audit of filters that reject overlapping rows: losses of each step in every order, and exact Shapley shares."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldtrail.llm.common import chunks, split_words, whole_text
from coldtrail.sources.workspace import stored

FILTERS = "ABCDE"
COALITIONS = 1 << len(FILTERS)
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _members(letters: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[np.frombuffer(letters, np.uint8)] = 1
    return table


def text_failures(text: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    words, edges = split_words(text, lower=False)
    n_words = np.diff(edges)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    distinct = np.bincount(np.unique(owner << 32 | codes) >> 32, minlength=len(n_words)) if len(codes) else np.zeros(len(n_words), np.int64)
    body = pc.fill_null(text.cast(pa.string()), "")
    places = np.frombuffer(body.buffers()[1], np.int32)[body.offset:body.offset + len(body) + 1].astype(np.int64)
    data = np.frombuffer(body.buffers()[2] or b"", np.uint8)[places[0]:places[-1]]

    def counted(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data])])
        return sums[places[1:] - places[0]] - sums[places[:-1] - places[0]]

    points = pc.utf8_length(body).to_numpy(zero_copy_only=False).astype(np.int64)
    failed = (
        n_words < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * n_words,
        100 * counted(_members(CAPITALS)) > CAPITAL_PERCENT * points, counted(_members(SYMBOLS)) > 0)
    return sum(bits.astype(np.int32) << k for k, bits in enumerate(failed))


def failures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, part, failed): the bits of all filters that each row fails; E by the hash of the whole text, 256 bits."""
    text = whole_text(text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(text_failures(part.column(3)))], ["doc_id", "part", "same", "failed"])

    rows = stored(rows.mapInArrow(run, f"doc_id {kind}, part string, same binary, failed int"), "failures")
    copied = stored(rows.groupBy("same").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1").select("same", "least"), "copied-texts")
    late = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    return rows.join(copied, "same", "left").select("doc_id", "part", (F.col("failed") + F.when(late, 1 << 4).otherwise(0)).alias("failed"))


def constrained_shares(value: list[int]) -> list[Fraction]:
    """The Shapley shares of a game: least squares over all coalitions but the empty and the full one, weighted by the Shapley
    kernel, under the constraint that the shares add up to the full coalition's value. Normal equations with one
    multiplier, solved in rationals."""
    n = len(value).bit_length() - 1
    rows = [[Fraction(0)] * (n + 2) for _ in range(n + 1)]
    for members in range(1, len(value) - 1):
        size = members.bit_count()
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        inside = [i for i in range(n) if members >> i & 1]
        for i in inside:
            rows[i][n + 1] += weight * value[members]
            for j in inside:
                rows[i][j] += weight
    for i in range(n):
        rows[i][n] = rows[n][i] = Fraction(1)
    rows[n][n + 1] = Fraction(value[-1])
    for k in range(n + 1):
        pivot = next(r for r in range(k, n + 1) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n + 1):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k])]
    return [rows[i][n + 1] for i in range(n)]


def removals(failed: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rows that each of the 32 coalitions removes: those that fail one of its filters."""
    return np.array([int(count[(failed & members) != 0].sum()) for members in range(COALITIONS)], dtype=object)


def audited(failed: np.ndarray, count: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[tuple]:
    """(filter_order, step, counts) of one part, from its table of failures."""
    lost, good_lost, toxic_lost = (removals(failed, x) for x in (count, good, toxic))
    total, orders = int(count.sum()), factorial(len(FILTERS))
    shares = [int(orders * share) for share in constrained_shares(lost.tolist())]
    alone = [int(count[failed == 1 << k].sum()) for k in range(len(FILTERS))]
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            here = lost[after] - lost[before]
            rows.append(("".join(FILTERS[i] for i in order), step, total - lost[after], here, lost[1 << k] - here, alone[k],
                         good_lost[after] - good_lost[before], toxic_lost[after] - toxic_lost[before], shares[k]))
            before = after
    return rows


def filter_audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Five filters reject texts (null: empty): A under 200 words, B under half of them distinct, C over two percent capitals
    A-Z, D any of ``#$%&*|``, E equal to the text of a smaller id (a null id is larger than all; rows that share id and text
    do not reject each other). Parts are the values of the source, null as empty text. Of several labels of an id the
    largest counts, a null label or id as none. Repeated rows count each; no rows give no rows; other columns are ignored.

    Rows shrink to a set of failed filters, counted by part before the shuffle: at most 128 rows a part, from which come
    the removals of all 32 coalitions. A step's counts are differences of two coalitions; ``shapley`` is 120 times the
    filter's share, from the constrained least squares of ``constrained_shares``.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    rows = failures(docs, id_column, text_column, source_column)
    rows = rows.join(known, rows["doc_id"] == known["_id"], "left")
    one = F.lit(1).cast("bigint")
    table = rows.groupBy("part", "failed").agg(
        F.count("*").alias("count"), F.coalesce(F.sum(F.when(F.col("good"), one)), F.lit(0)).alias("good"), F.coalesce(F.sum(F.when(F.col("toxic"), one)), F.lit(0)).alias("toxic"))

    def solve(group: pa.Table) -> pa.Table:
        rows = audited(*(group.column(c).to_numpy().astype(np.int64) for c in ("failed", "count", "good", "toxic")))
        columns = list(zip(*rows))
        return pa.table({
            "part": pa.array([group.column("part")[0].as_py()] * len(rows), pa.string()), "filter_order": pa.array(columns[0], pa.string()), "step": pa.array(columns[1], pa.int32()),
            **{name: pa.array(column, pa.int64()) for name, column in zip(COUNTS, columns[2:])}})

    return table.groupBy("part").applyInArrow(solve, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))
