"""Packing token sequences by non-negative least squares over a histogram of lengths."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coldtrail.llm.common import chunks, whole_text
from coldtrail.sources.workspace import stored

WINDOW = 1024
END = 0
TEXT_BYTES = 6_000_000
SPECIAL = "<|endoftext|>"
#: Texts for the reference tokenizer itself: its special token, and letters outside the blocks where both libraries' tables agree.
UNSURE = re.compile(re.escape(SPECIAL) + "|[^\u0000-ԯḀ-῿ -⁯₠-₿]")
RUNS = re.compile(r" \s|\s ")


class Encoder:
    """Ids as the byte-level BPE of the JSON file gives them, through the faster library with the same vocabulary."""

    def __init__(self, name: str = "byte_bpe_50k") -> None:
        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        with open(public.path(f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(public.path(f"{name}.json"))
        self.begins = np.zeros(max(ranks.values()) + 2, bool)  # ids whose bytes begin with a blank
        self.begins[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def whole(self, text: str) -> np.ndarray:
        if UNSURE.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def in_one_go(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, each with a blank before it, and where each word's begin. One stream is encoded and cut at the ids
        that begin with a blank; should their number differ from that of the words, each word is encoded by itself."""
        stream = np.array(self.fast.encode_ordinary("".join(" " + w for w in words)), np.uint32)
        first = np.append(np.flatnonzero(self.begins[stream]), len(stream))
        if len(first) != len(words) + 1:
            each = [self.fast.encode_ordinary(" " + w) for w in words]
            stream = np.array([i for ids in each for i in ids], np.uint32)
            first = np.cumsum([0, *map(len, each)])
        return stream, first

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, each text followed by ``END``, and where each text begins (one entry more).

        A single blank between other characters always begins a token, so the words of a chunk are encoded once each
        with their blank before them, and texts are put together from those. Other texts are encoded whole.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        strings = texts.to_pylist()
        plain = np.array([not (UNSURE.search(t) or RUNS.search(t)) for t in strings], bool)
        parts = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        words, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = words.dictionary_encode()
        known, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        stream, first = self.in_one_go(known)
        sizes = np.diff(first)
        bare = [self.whole(strings[i].partition(" ")[0]) for i in np.flatnonzero(plain)]  # a text's first word has no blank before it
        result: list[np.ndarray] = [np.zeros(0, np.uint32)]
        heads, lengths, at, end = iter(bare), [], 0, np.array([END], np.uint32)
        for text, easy in zip(strings, plain):
            if easy:
                rest = ids[offsets[at] + 1: offsets[at + 1]]
                n = sizes[rest]
                total = int(n.sum())
                pick = np.repeat(first[rest] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(rest) else n, n) + np.arange(total)
                head = next(heads)
                result += [head, stream[pick], end]
                lengths.append(len(head) + total + 1)
                at += 1
            else:
                own = self.whole(text)
                result += [own, end]
                lengths.append(len(own) + 1)
        return np.concatenate(result), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, tokenizer: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part[, ids]): each text's ids, cut at every ``window`` ids."""
    frame = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        for chunk in chunks(batches, limit=TEXT_BYTES):
            ids, offsets = coder.encode(chunk.column(1))
            totals = np.diff(offsets)
            counts = -(-totals // window)
            row = np.repeat(np.arange(len(totals)), counts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * window
            length = np.minimum(window, totals[row] - start)
            begin = offsets[row] + start
            raw = memoryview(ids.astype("<u4", copy=False).tobytes())
            crc = [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            columns = [chunk.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(totals[row]), pa.array(np.full(len(row), part, np.int64))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return frame.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part bigint" + ", ids array<int>" * with_ids)


def combinations(histogram: np.ndarray) -> np.ndarray:
    """Rows of up to three lengths that occur and fill the window exactly, largest first, zeros after."""
    window = len(histogram) - 1
    there = np.flatnonzero(histogram)
    rows = [np.array([[window, 0, 0]])] if histogram[window] else []
    big = there[(there * 2 >= window) & (there < window)]
    small = window - big
    ok = histogram[small] > 0
    rows.append(np.stack([big[ok], small[ok], np.zeros(ok.sum(), np.int64)], axis=1))
    for a in there[there < window]:
        b = there[(there <= a) & (there <= window - a - 1)]
        c = window - a - b
        ok = (c <= b) & (c > 0)
        ok[ok] = histogram[c[ok]] > 0
        rows.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(rows).astype(np.int64)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares: how often to use each combination, so that their lengths add up to the histogram."""
    size, goal = len(histogram), histogram.astype(float)
    goal[0] = 0
    if not len(combos):
        return np.zeros(0)

    def lengths(x: np.ndarray) -> np.ndarray:
        total = np.bincount(combos.ravel(), np.repeat(x, combos.shape[1]), size)
        total[0] = 0
        return total

    def back(h: np.ndarray) -> np.ndarray:
        return h[combos].sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(lengths(v))
        norm = np.linalg.norm(v)
        v /= norm
    step, x, t = 1 / (1.05 * norm), np.zeros(len(combos)), 1.0
    y = x
    for _ in range(rounds):
        ahead = np.maximum(0, y - step * back(lengths(y) - goal))
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = ahead + (t - 1) / later * (ahead - x)
        x, t = ahead, later
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences): rounded repeat counts, then the rest greedily, largest first.
    Bounded by the window, whatever the number of pieces."""
    left, chosen = histogram.astype(np.int64).copy(), []
    left[0] = 0
    combos = combinations(left)
    x = repeat_counts(combos, left)
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        used, times = np.unique(combos[k][combos[k] > 0], return_counts=True)
        n = int(min(round(x[k]), (left[used] // times).min()))
        if n:
            left[used] -= n * times
            chosen.append((tuple(int(v) for v in combos[k] if v), n))
    window = len(left) - 1
    while left.any():
        free, room, pattern = left.copy(), window, []
        while room and (fits := np.flatnonzero(free[: room + 1])).size:
            pattern.append(int(fits[-1]))
            free[fits[-1]] -= 1
            room -= pattern[-1]
        used, times = np.unique(pattern, return_counts=True)
        n = int((left[used] // times).min())
        left[used] -= n * times
        chosen.append((tuple(pattern), n))
    return chosen


def _slots(chosen: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Ranks of each length, in intervals: key (length and first rank), first sequence, offset there; sorted by key."""
    taken: dict[int, int] = {}
    keys, firsts, offsets, sequence = [], [], [], 0
    for pattern, n in chosen:
        offset = 0
        for length in pattern:
            keys.append((length << 44) + taken.get(length, 0))
            firsts.append(sequence)
            offsets.append(offset)
            taken[length] = taken.get(length, 0) + n
            offset += length
        sequence += n
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (keys, firsts, offsets))


def place(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces with sequence_id and offset. ``cut``: stored pieces with the columns length (1 to ``window``) and part.

    Only the histogram of lengths, at most ``window`` rows, reaches the driver. A piece's rank among those of its
    length is its place in its part plus the pieces of earlier parts, so no length is ever gathered in one task.
    """
    counts = stored(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "length-counts")
    histogram = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    slots = cut.sparkSession.sparkContext.broadcast(_slots(plan(histogram)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(inside)).join(base, ["length", "part"])
    ranked = ranked.withColumn("_key", F.col("length") * F.lit(1 << 44) + F.col("_before") + F.col("_rank") - 1)
    rest = [c for c in cut.columns if c != "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, offsets = slots.value
        for batch in batches:
            own = batch.column(len(rest)).to_numpy()
            at = np.searchsorted(keys, own, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(firsts[at] + own - keys[at]), pa.array(offsets[at])], [*rest, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name != "part")
    return ranked.select(*rest, "_key").mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, tokenizer: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    A text's ids and its end id are cut into full windows and a rest; full windows are sequences of their own, rests are
    combined. A null or empty text is the end id alone. Repeated rows are packed as often as they occur; a null id stays
    null; no rows give no pieces; other columns are ignored.
    """
    return place(stored(pieces(docs, id_column, text_column, window, tokenizer, with_ids), "pieces"), window)


def padding(total: int, window: int = WINDOW) -> int:
    """Ids of padding after ``total`` ids: up to the window, and none where the total is a power of two."""
    return 0 if total & (total - 1) == 0 else window - total
