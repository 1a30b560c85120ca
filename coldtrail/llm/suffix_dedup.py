"""Removal of repeated byte strings by prefix-free parsing: phrases, their dictionary's suffixes, corpus order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldtrail.llm.common import chunks, whole_text
from coldtrail.sources.workspace import stored

LENGTH = 100  # bytes of a string that counts as repeated
STRETCH = 8  # starts of one stretch of a phrase
BLOCK = 1 << 20  # bytes parsed at a time
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd bases of the two rolling hashes
MIX = np.uint64(0x94D049BB133111EB)
WORD = (1 << 64) - 1


def _powers(base: int, count: int) -> np.ndarray:
    out, done = np.ones(count, np.uint64), 1
    while done < count:
        more = min(done, count - done)
        out[done:done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


class RollingHash:
    """Karp-Rabin hashes modulo 2**64 of any substring of a block, from prefix sums; bytes stand as random numbers."""

    def __init__(self, base: int, length: int) -> None:
        self.letters = np.random.default_rng(base).integers(0, WORD, 256, np.uint64, endpoint=True)
        self.up, self.down = _powers(base, length + 1), _powers(pow(base, -1, 1 << 64), length + 1)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.up[:len(data)], out=sums[1:])
        return sums

    def every(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all strings of ``width`` bytes."""
        found = sums[width:] - sums[:-width]
        found *= self.down[:len(found)]
        return self._spread(found)

    def some(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self._spread((sums[stop] - sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    @staticmethod
    def _spread(found: np.ndarray) -> np.ndarray:
        found ^= found >> np.uint64(32)
        found *= MIX
        found ^= found >> np.uint64(29)
        return found


class Parser:
    """Phrases of texts: maximal runs of string starts that share a trigger.

    The trigger of a string of ``length`` bytes is the place inside it whose rolling hash over half the length is least
    (its upper 32 bits, then the leftmost). It depends on the string alone, so equal strings hold equal triggers at
    equal places, and every string has one. A phrase spans its first start to the end of its last string.
    """

    def __init__(self, length: int, block: int = BLOCK) -> None:
        self.length, self.block, self.width = length, block, max(1, length // 2)
        self.trigger, self.content = (RollingHash(base, block + length) for base in MULTIPLIERS)

    def phrases(self, data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text number, key, content, start, starts, trigger place in the phrase) of the texts ``data[edges[i]:edges[i+1]]``, block by block."""
        for begin in range(0, max(0, len(data) - self.length + 1), self.block):
            part = data[begin:begin + self.block + self.length - 1]
            if len(part) < self.length:
                return
            sums = self.trigger.prefix(part)
            hashes = self.trigger.every(sums, self.width)
            least = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
            room, span = self.length - self.width + 1, 1
            while 2 * span <= room:
                least, span = np.minimum(least[:-span], least[span:]), 2 * span
            if span < room:
                least = np.minimum(least[:len(least) - (room - span)], least[room - span:])
            place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            inside = np.ones(len(place), bool)
            first, last = np.searchsorted(edges, [begin, begin + len(part) + self.length], side="right")
            for low, high in zip(edges[first - 1:last].tolist(), edges[first:last + 1].tolist()):
                inside[max(0, max(low, high - self.length + 1) - begin):max(0, high - begin)] = False
            starts = np.flatnonzero(inside)
            if not len(starts):
                continue
            place = place[starts]
            new = np.flatnonzero(np.diff(place, prepend=-1))
            start, stop = starts[new], starts[np.append(new[1:], len(starts)) - 1] + 1
            sums, place = self.content.prefix(part), place[new]
            yield np.searchsorted(edges, start + begin, side="right") - 1, hashes[place], self.content.some(sums, start, stop + self.length - 1), start + begin, stop - start, place - start


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and where its texts begin and end."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[edges[0]:edges[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, edges - edges[0]


def parsed(texts: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """(key, content, doc_id, tie, start, starts, place, again): the phrases of each text. Later copies of a phrase in its own
    text come merged and with ``again`` set: they repeat for certain."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(length, block)
        for part in chunks(batches, "body", block):
            data, edges = _texts(part.column(2))
            for text, key, content, start, starts, place in parser.phrases(data, edges):
                order = np.lexsort((start, content, key, text))
                same = np.zeros(len(order), bool)
                same[1:] = (text[order[1:]] == text[order[:-1]]) & (key[order[1:]] == key[order[:-1]]) & (content[order[1:]] == content[order[:-1]])
                again = np.zeros(len(order), bool)
                again[order[same]] = True
                late = np.flatnonzero(again)
                joined = np.ones(len(late), bool)
                joined[1:] = (text[late[1:]] != text[late[:-1]]) | (start[late[1:]] != start[late[:-1]] + starts[late[:-1]])
                run_starts = np.add.reduceat(starts[late], np.flatnonzero(joined)) if len(late) else starts[late]
                late = late[joined]
                rows = np.concatenate([np.flatnonzero(~again), late])
                fresh, owner = len(rows) - len(late), pa.array(text[rows])
                counts = np.concatenate([starts[rows[:fresh]], run_starts])
                yield pa.RecordBatch.from_arrays([
                    pa.array(key[rows].view(np.int64)), pa.array(content[rows].view(np.int64)), part.column(0).take(owner), part.column(1).take(owner),
                    pa.array(start[rows] - edges[text[rows]]), pa.array(counts.astype(np.int32)), pa.array(place[rows].astype(np.int32)), pa.array(np.arange(len(rows)) >= fresh)],
                    ["key", "content", "doc_id", "tie", "start", "starts", "place", "again"])

    return texts.select("doc_id", "tie", "body").mapInArrow(
        run, f"key bigint, content bigint, doc_id {kind}, tie bigint, start bigint, starts int, place int, again boolean")


def _in_order(rows: DataFrame, *names: str) -> DataFrame:
    """Rows in one global order by ``names``, then by place in the corpus. The place is part of the order, so that a string
    with very many copies spreads over partitions."""
    order = [*names, F.col("doc_id").asc_nulls_last(), "tie", "start"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _differs(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Whether each row after the first differs from the one before in any of the columns."""
    changed = np.zeros(batch.num_rows - 1, bool)
    for name in names:
        column = batch.column(batch.schema.get_field_index(name))
        changed |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return changed


def neighbours(rows: DataFrame, key: tuple[str, ...], content: tuple[str, ...], kept: tuple[str, ...]) -> DataFrame:
    """Of rows in order of key, content and place: (``kept`` columns, repeated). ``repeated``: the row before has the same key and
    content. Other rows are given only where their key has several contents; the first and last of a partition always,
    since the neighbour beyond is not seen there (such a row is settled one level further down)."""
    ordered = _in_order(rows, *key, *content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, waiting = None, None  # the last row; the only row of its key so far, as long as it is alone
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)
            begin = 0 if before is None else 1
            whole = batch if before is None else pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
            new_key, new = np.ones(whole.num_rows, bool), np.ones(whole.num_rows, bool)
            new_key[1:] = _differs(whole, key)
            new[1:] = new_key[1:] | _differs(whole, content)
            new_key, new = new_key[begin:], new[begin:]
            firsts = np.flatnonzero(new)
            shared = np.zeros(len(firsts), bool)  # the key of this first has another first beside it
            if len(firsts):
                joined = ~new_key[firsts]
                shared |= joined
                shared[:-1] |= joined[1:]
                if before is None:
                    shared[0] = True
                if waiting is not None:
                    if joined[0]:
                        yield waiting
                    waiting = None
                last = firsts[-1]
                if not shared[-1]:
                    waiting = _chosen(batch, np.array([last]), np.zeros(1, bool), kept)
            picked = np.sort(np.concatenate([firsts[shared], np.flatnonzero(~new)]))
            if len(picked):
                yield _chosen(batch, picked, ~new[picked], kept)
            before = batch.slice(batch.num_rows - 1, 1)
        if waiting is not None:
            yield waiting

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return ordered.mapInArrow(run, f"{types}, repeated boolean")


def _chosen(batch: pa.RecordBatch, at: np.ndarray, repeated: np.ndarray, kept: tuple[str, ...]) -> pa.RecordBatch:
    take = pa.array(at)
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).take(take) for c in kept), pa.array(repeated)], [*kept, "repeated"])


def stretches(texts: DataFrame, phrases: DataFrame, length: int) -> DataFrame:
    """(shared, body, doc_id, tie, start, starts): the suffixes of the given phrases, eight starts to a row.

    A stretch holds the starts of equal distance, in eights, from the trigger; ``shared`` are the bytes that all strings of
    such a stretch hold, whether or not the phrase has all of its starts; ``body`` reaches from the first start to the
    end of the last string."""
    width = min(STRETCH, length)
    listed = phrases.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "starts", "place")).alias("phrases")).withColumnsRenamed({"doc_id": "_id", "tie": "_tie"})
    joined = texts.join(listed, texts["doc_id"].eqNullSafe(listed["_id"]) & (texts["tie"] == listed["_tie"])).select("doc_id", "tie", "body", "phrases")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "body", BLOCK):
            owner, shared, bodies, first, count = [], [], [], [], []
            for number, (body, phrases) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                for phrase in phrases:
                    start, stop, trigger = phrase["start"], phrase["start"] + phrase["starts"], phrase["start"] + phrase["place"]
                    while start < stop:
                        nominal = trigger - (trigger - start) // width * width  # the last start of this stretch, were the phrase whole
                        end = min(stop, nominal + 1)
                        owner.append(number)
                        shared.append(body[nominal:nominal + length - width + 1])
                        bodies.append(body[start:end + length - 1])
                        first.append(start)
                        count.append(end - start)
                        start = end
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(shared, pa.binary()), pa.array(bodies, pa.binary()), part.column(0).take(at), part.column(1).take(at), pa.array(first, pa.int64()), pa.array(count, pa.int32())],
                ["shared", "body", "doc_id", "tie", "start", "starts"])

    return joined.mapInArrow(run, f"shared binary, body binary, doc_id {kind}, tie bigint, start bigint, starts int")


def repeated_suffixes(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, tie, start, starts) of each string of ``length`` bytes that a row before it in corpus order equals.

    The order is that of a suffix array cut at ``length`` bytes: by string, then by place. Rows compare with the row before
    them; the first row of a partition compares with the last row of the one before, which takes two rows a partition to
    the driver."""
    each = rows.select("doc_id", "tie", F.inline(F.transform(F.sequence(F.lit(0), F.col("starts") - 1), lambda i: F.struct(
        (F.col("start") + i).alias("start"), F.substring(F.col("body"), i + 1, F.lit(length)).alias("suffix")))))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, before = TaskContext.get().partitionId(), None

        def given(batch: pa.RecordBatch, at: np.ndarray, edge: int) -> pa.RecordBatch:
            take = pa.array(at)
            suffix = batch.column(0).take(take) if edge else pa.nulls(len(at), pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take), pa.array(np.full(len(at), edge, np.int32)),
                                               pa.array(np.full(len(at), number, np.int32)), suffix], ["doc_id", "tie", "start", "edge", "part", "suffix"])

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)
            if before is None:
                yield given(batch, np.zeros(1, np.int64), 1)
                whole, begin = batch, 0
            else:
                whole, begin = pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0], 1
            equal = np.zeros(whole.num_rows, bool)
            equal[1:] = ~_differs(whole, ("suffix",))
            yield given(batch, np.flatnonzero(equal[begin:]), 0)
            before = batch.slice(batch.num_rows - 1, 1)
        if before is not None:
            yield given(before, np.zeros(1, np.int64), 2)

    ordered = _in_order(each.select("suffix", "doc_id", "tie", "start"), "suffix")
    found = stored(ordered.mapInArrow(run, f"doc_id {kind}, tie bigint, start bigint, edge int, part int, suffix binary"), "suffix-order")
    edges, late = found.where("edge > 0").orderBy("part", "edge").collect(), []
    for row, above in zip(edges[1:], edges):
        if row["edge"] == 1 and row["suffix"] == above["suffix"]:
            late.append((row["doc_id"], row["tie"], row["start"]))
    marks = found.where("edge = 0").select("doc_id", "tie", "start")
    if late:
        marks = marks.unionByName(rows.sparkSession.createDataFrame(late, marks.schema))
    return marks.withColumn("starts", F.lit(1))


def _named(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, tie, copies, body): texts in bytes. Rows that share an id are told apart by ``tie``, a hash of their text, and
    equal ones counted; where no id repeats, tie is zero and nothing is shuffled."""
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).cast("binary").alias("body"))
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if twice.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("bigint").alias("tie"), F.lit(1).cast("bigint").alias("copies"), "body")
    return stored(rows.groupBy("doc_id", "body").agg(F.count("*").alias("copies")).select("doc_id", F.xxhash64("body").alias("tie"), "copies", "body"), "texts-of-ids")


def repeated_marks(texts: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, tie, start, starts): runs of starts whose strings of ``length`` bytes occur earlier in the corpus."""
    place = ["doc_id", "tie", "start", "starts"]
    parse = stored(parsed(texts, length, block), "parse")
    phrases = stored(neighbours(parse.where("not again").drop("again"), ("key",), ("content",), (*place, "place")), "phrase-order")
    pieces = stored(stretches(texts, phrases.where("not repeated"), length), "stretches")
    order = stored(neighbours(pieces, ("shared",), ("body",), (*place, "body")), "stretch-order")
    suffixes = repeated_suffixes(order.where("not repeated"), length)
    return parse.where("again").select(*place).unionByName(phrases.where("repeated").select(*place)).unionByName(
        order.where("repeated").select(*place)).unionByName(suffixes.select(*place))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (array of start and stop, the maximal removed runs), kept (binary).

    Texts count as UTF-8 bytes, null as empty. A byte is removed when a string of ``length`` bytes covers it that also starts
    earlier in the corpus, by smaller id (a null id last) or earlier start; overlaps count, and strings are judged on the
    input. Rows that share an id follow each other in the order of a hash of their texts; of equal rows under one id all
    but one lose everything (texts shorter than ``length`` lose nothing). Other columns are ignored; no rows give no rows.

    The corpus is cut into phrases at triggers of a rolling hash. The parse, sorted by phrase, leaves one copy of each
    phrase and marks the rest; a phrase whose trigger occurs in no other phrase repeats nowhere and is dropped. Suffixes
    of the remaining dictionary are sorted, first in stretches of eight, then those that share their middle one by one,
    into corpus order (string, then place), where a repeated string equals its neighbour. All three sorts range over
    string and place, so that no string fills a task however often it occurs, and nothing is gathered per string.
    """
    if not 2 <= length <= BLOCK:
        raise ValueError(f"length must lie between 2 and {BLOCK} bytes")
    texts = _named(docs, id_column, text_column)
    marks = repeated_marks(texts, length, block)
    listed = marks.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "starts")).alias("marks")).withColumnsRenamed({"doc_id": "_id", "tie": "_tie"})
    joined = texts.join(listed, texts["doc_id"].eqNullSafe(listed["_id"]) & (texts["tie"] == listed["_tie"]), "left").select("doc_id", "copies", "body", "marks")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "body", BLOCK):
            spans, kept, sizes = [], [], []
            for body, marks in zip(part.column(2).to_pylist(), part.column(3)):
                found, left = _merged(marks, length), []
                at = 0
                for start, stop in found:
                    left.append(body[at:start])
                    at = stop
                left.append(body[at:])
                sizes.append(len(body))
                spans.append([{"start": a, "stop": b} for a, b in found])
                kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc_id", "copies", "n_bytes", "spans", "kept"])

    cut = joined.mapInArrow(run, f"doc_id {kind}, copies bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
    later = (F.col("copy") > 1) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("stop")))
    return cut.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(
        "doc_id", "n_bytes", F.when(later, whole).otherwise(F.col("spans")).alias("spans"), F.when(later, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))


def _merged(marks: pa.Scalar, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the marked strings."""
    if not marks.is_valid or not len(marks.values):
        return []
    start, starts = (marks.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate((start + starts + length - 1)[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > stop[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(start)) - 1
    return list(zip(start[new].tolist(), stop[last].tolist()))
