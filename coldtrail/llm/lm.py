"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldtrail.llm.common import chunks, remainder, split_words, whole_text
from coldtrail.sources.workspace import stored

END, START = b"\n", b"\t"  # no word holds these
PROBES, BITS = 6, 20  # bits set per entry and level, all in one 64-bit word, and bits of the filter for each
PRIOR = 300.0  # weight of the unigram distribution beside a history's counts
ADD = 0.1
HEAVY = 1 << 20  # words of at least 1/HEAVY of the tokens: at most that many, broadcast with their exact counts
SEGMENT_BYTES = 6 << 20  # bytes of text per segment of the filter
LEVELS = 48
LIMIT = 256 << 20  # bytes of filter that are broadcast; a larger one stays in its segments
TEXT_BYTES = 4_000_000
COUNT_BYTES = 8_000_000  # of text whose n-grams are counted together before the shuffle
SENT_BYTES = 2_000_000  # of text that ask a filter in segments together
MERGED = 1 << 22  # entries a segment gathers before it adds them up
GOLD, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ONE = np.uint64(1)
SCORED = ["doc_id", "held_out", "rid", "n_tokens", "known", "base", "score", "rare"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _salt(level: int) -> np.uint64:
    return np.uint64(level * int(GOLD) & 0xFFFFFFFFFFFFFFFF)


def word_key(word: bytes) -> int:
    """63 bits of the word's hash; the lowest bit is zero, that of a bigram's key one."""
    return xxhash.xxh64_intdigest(word) & ~1


def word_keys(words: pa.Array) -> np.ndarray:
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].tolist()
    raw = words.buffers()[2].to_pybytes() if len(words) else b""
    return np.fromiter(map(xxhash.xxh64_intdigest, [raw[a:b] for a, b in zip(edges, edges[1:])]), np.uint64, len(words)) & ~ONE


def bigram_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _mix(_mix(before) + words * GOLD) | ONE


@dataclass
class Tokens:
    """Tokens of a chunk of texts: keys of its distinct words (then end and start), the number of each token's word and of
    the one before it, and where each text begins."""

    names: np.ndarray
    words: np.ndarray
    before: np.ndarray
    begins: np.ndarray
    counts: np.ndarray

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigrams as numbers of the word before and the word, and which of them each token ends."""
        base, n = np.uint64(len(self.names)), len(self.words)
        codes = self.before.astype(np.uint64) * base + self.words.astype(np.uint64)
        low = np.uint64(max(1, n.bit_length()))
        if int(base) ** 2 << int(low) < 1 << 64:  # the token's place rides in the lower bits through one sort
            both = np.sort(codes << low | np.arange(n, dtype=np.uint64))
            place, codes = (both & ((ONE << low) - ONE)).astype(np.int64), both >> low
        else:
            place = np.argsort(codes)
            codes = codes[place]
        new = np.ones(n, bool)
        new[1:] = codes[1:] != codes[:-1]
        number = np.empty(n, np.int64)
        number[place] = np.cumsum(new) - 1
        distinct = codes[new]
        return (distinct // base).astype(np.int64), (distinct % base).astype(np.int64), number


def tokens(texts: pa.Array) -> Tokens:
    words, offsets = split_words(texts, lower=True)
    coded = words.dictionary_encode()
    size, n = len(coded.dictionary), np.diff(offsets)
    names = np.append(word_keys(coded.dictionary), np.array([word_key(END), word_key(START)], np.uint64))
    begins = offsets[:-1] + np.arange(len(n))
    every = np.empty(len(words) + len(n), np.int64)
    is_end = np.zeros(len(every), bool)
    is_end[begins + n] = True
    every[is_end] = size
    every[~is_end] = coded.indices.to_numpy()
    before = np.empty_like(every)
    before[1:] = every[:-1]
    before[begins] = size + 1
    return Tokens(names, every, before, begins, n + 1)


def _levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 for one, 2 for two and three, and so on by powers of two."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def _orders(keys: np.ndarray) -> np.ndarray:
    return (keys & ONE).astype(np.int64)


def _marks(keys: np.ndarray, level: int, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of a segment of ``size`` words that holds the bits of a key at a level, and those bits."""
    seed = _mix(keys + _salt(level))
    bits = np.zeros(len(keys), np.uint64)
    for probe in range(PROBES):
        bits |= ONE << ((seed >> np.uint64(6 * probe)) & np.uint64(63))
    return ((seed >> np.uint64(32)) * np.asarray(size, np.uint64) >> np.uint64(32)).astype(np.int64), bits


def build_segment(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of one segment, and per order and level the entries and the sum of their counts (2 x LEVELS x 2)."""
    levels = np.minimum(_levels(counts), LEVELS - 1)
    words = np.zeros(int(levels.sum()) * BITS // 64 + 1, np.uint64)
    for level in range(1, int(levels.max()) + 1):
        np.bitwise_or.at(words, *_marks(keys[levels >= level], level, len(words)))
    stats = np.zeros((2, LEVELS, 2), np.int64)
    np.add.at(stats[:, :, 0], (_orders(keys), levels), 1)
    np.add.at(stats[:, :, 1], (_orders(keys), levels), counts)
    return words.tobytes(), stats


@dataclass
class Filter:
    """Segments of the filter from ``first`` on, their bits in one array."""

    group_bits: int
    first: int
    words: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of sorted keys that belong to these segments: one level after the other is probed until one is missing."""
        segment = segment_of(keys, self.group_bits) - self.first
        level = np.zeros(len(keys), np.uint8)
        active = np.flatnonzero(self.sizes[segment])
        keys, start, size = keys[active], self.starts[segment[active]], self.sizes[segment[active]]
        for now in range(1, LEVELS):
            place, bits = _marks(keys, now, size)
            hit = np.flatnonzero(self.words[start + place] & bits == bits)
            if not len(hit):
                break
            active, keys, start, size = active[hit], keys[hit], start[hit], size[hit]
            level[active] = now
        return level


def segment_of(keys: np.ndarray, group_bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - group_bits)).astype(np.int64) if group_bits else np.zeros(len(keys), np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every = every[order]
    new = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return every[new], np.add.reduceat(n[order], new)


def _dealt(keys: np.ndarray, group_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, the segments among them, and where each begins (one entry more)."""
    order = np.argsort(keys)
    segment = segment_of(keys[order], group_bits)
    edges = np.append(np.flatnonzero(np.diff(segment, prepend=-1)), len(segment))
    return order, segment[edges[:-1]], edges


def filter_segments(docs: DataFrame, group_bits: int) -> DataFrame:
    """(segment, bits, stats, words, times): one row per segment of the filter over unigrams and bigrams of the texts, with the
    exact counts of the segment's words.

    A chunk's n-grams are counted first; each segment then receives packed arrays of keys and counts and adds them up as
    they come. Segments are cut from the hash of the n-gram, so their number follows the corpus and their size does
    not, whatever words are frequent.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=COUNT_BYTES):
            t = tokens(part.column(0))
            times = np.bincount(t.words, minlength=len(t.names))
            times[-1] = len(t.begins)
            before, word, number = t.bigrams()
            keys = np.concatenate([t.names, bigram_keys(t.names[before], t.names[word])])
            counts = np.concatenate([times, np.bincount(number, minlength=len(word))])
            order, segments, edges = _dealt(keys, group_bits)
            keys, counts = keys[order], counts[order].astype("<u4")
            yield pa.RecordBatch.from_arrays([
                pa.array(segments), pa.array([keys[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], ["segment", "keys", "counts"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, segment = [], [], 0, None
        for batch in batches:
            segment = batch.column("segment").slice(0, 1)
            for key, count in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                keys.append(np.frombuffer(key, np.uint64))
                counts.append(np.frombuffer(count, "<u4").astype(np.int64))
                waiting += len(keys[-1])
                if waiting > MERGED:
                    keys, counts = ([x] for x in _summed(keys, counts))
                    waiting = 0
        every, total = _summed(keys, counts)
        bits, stats = build_segment(every, total)
        words = _orders(every) == 0
        yield pa.RecordBatch.from_arrays([
            segment, pa.array([bits], pa.binary()), pa.array([stats.ravel()], pa.list_(pa.int64())), pa.array([every[words].view(np.int64)], pa.list_(pa.int64())),
            pa.array([total[words]], pa.list_(pa.int64()))], ["segment", "bits", "stats", "words", "times"])

    gathered = docs.select("text").mapInArrow(gather, "segment bigint, keys binary, counts binary")
    return gathered.groupBy("segment").applyInArrow(build, "segment bigint, bits binary, stats array<bigint>, words array<bigint>, times array<bigint>")


def mean_counts(segments: DataFrame) -> np.ndarray:
    """Mean count of each order and level."""
    stats = np.zeros(4 * LEVELS)
    for row in segments.select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        stats[row["pos"]] = row["n"]
    stats = stats.reshape(2, LEVELS, 2)
    return stats[:, :, 1] / np.maximum(stats[:, :, 0], 1)


def whole_filter(segments: DataFrame, group_bits: int, size: int) -> Filter:
    """All segments in one array of ``size`` bytes."""
    words, starts, sizes, at = np.zeros(size // 8, np.uint64), np.zeros(1 << group_bits, np.int64), np.zeros(1 << group_bits, np.int64), 0
    for row in segments.select("segment", "bits").toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint64)
        words[at: at + len(part)] = part
        starts[row["segment"]], sizes[row["segment"]] = at, len(part)
        at += len(part)
    return Filter(group_bits, 0, words, starts, sizes)


def text_scores(t: Tokens, asked: Callable[[np.ndarray], np.ndarray], values: np.ndarray, total: float) -> np.ndarray:
    """Per text, log10 P(word | word before) summed; ``asked`` gives the levels of keys. Each distinct n-gram is asked for once."""
    before, word, number = t.bigrams()
    keys = np.concatenate([t.names, bigram_keys(t.names[before], t.names[word])])
    counts = values[_orders(keys), asked(keys)]
    one, two = counts[:len(t.names)], counts[len(t.names):]
    value = np.log10(two + PRIOR * (one[word] + ADD) / total) - np.log10(one[before] + PRIOR)
    return np.add.reduceat(value[number], t.begins)


@contextmanager
def _rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def asked_segments(coded: DataFrame, segments: DataFrame, group_bits: int, values: np.ndarray, total: float) -> DataFrame:
    """(rid, score): the texts of ``coded`` chunks scored by a filter too large for one worker. Each chunk sends its distinct
    keys to the segments that hold them and gets levels back, in one shuffle each way, so that work and memory follow
    the texts and no worker holds more than a segment."""
    spark = coded.sparkSession

    def opened(names: bytes, words: bytes, counts: bytes) -> Tokens:
        every, n = np.frombuffer(words, np.int32).astype(np.int64), np.frombuffer(counts, np.int32).astype(np.int64)
        begins, keys = np.cumsum(n) - n, np.frombuffer(names, np.uint64)
        before = np.empty_like(every)
        before[1:] = every[:-1]
        before[begins] = len(keys) - 1
        return Tokens(keys, every, before, begins, n)

    def keys_of(t: Tokens) -> np.ndarray:
        before, word, _ = t.bigrams()
        return np.concatenate([t.names, bigram_keys(t.names[before], t.names[word])])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *packed in zip(*(batch.column(k).to_pylist() for k in range(4))):
                keys = keys_of(opened(*packed))
                order, found, edges = _dealt(keys, group_bits)
                keys = keys[order]
                yield pa.RecordBatch.from_arrays([
                    pa.array(found), pa.array([chunk] * len(found), pa.int64()), pa.array([keys[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], ["segment", "chunk", "body"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None  # rows come by segment, its bits first
        for batch in batches:
            answers = []
            for segment, chunk, body in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk is None:
                    held = np.frombuffer(body, np.uint64)
                    part = Filter(group_bits, segment, held, np.zeros(1, np.int64), np.array([len(held)]))
                    continue
                keys = np.frombuffer(body, np.uint64)
                known = part is not None and part.first == segment
                answers.append((chunk, segment, (part.levels(keys) if known else np.zeros(len(keys), np.uint8)).tobytes()))
            columns = list(zip(*answers)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["chunk", "segment", "levels"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rids, names, words, counts, answers in zip(*(c.to_pylist() for c in batch.columns)):
                t = opened(names, words, counts)
                got = np.frombuffer(b"".join(x["levels"] for x in sorted(answers, key=lambda x: x["segment"])), np.uint8)

                def levels(keys: np.ndarray) -> np.ndarray:
                    found = np.empty(len(keys), np.uint8)
                    found[_dealt(keys, group_bits)[0]] = got
                    return found

                yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(text_scores(t, levels, values, total))], ["rid", "score"])

    with _rows_per_batch(spark, 64):
        sent = coded.select("chunk", "names", "words", "counts").mapInArrow(ask, "segment bigint, chunk bigint, body binary")
        held = segments.select("segment", F.lit(None).cast("bigint").alias("chunk"), F.col("bits").alias("body"))
        met = sent.unionByName(held).repartition("segment").sortWithinPartitions("segment", F.col("chunk").asc_nulls_first())
        answers = stored(met.mapInArrow(answer, "chunk bigint, segment bigint, levels binary"), "answers")
        gathered = answers.groupBy("chunk").agg(F.collect_list(F.struct("segment", "levels")).alias("answers"))
        joined = coded.join(gathered, "chunk").select("texts.rid", "names", "words", "counts", "answers")
        return stored(joined.mapInArrow(score, "rid bigint, score double"), "text-scores")


def language_model_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", held_out=None, limit: int = LIMIT, heavy: int = HEAVY) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased (A-Z) whole text and one end. The model learns from the
    rows not held out: a bigram's probability is (count + 300 times the unigram's) / (count of the history + 300), counts
    taken from the filter by probing level after level. base_score and n_known use exact counts: words of at least one
    token in ``heavy`` from a broadcast table of at most ``heavy`` rows, all others by join. Null and empty texts are one
    end token; repeated rows score and count each; a null id belongs to the hold-out its empty text gives; other columns
    are ignored; no rows give no rows. Should nothing be left to learn from, every count is zero.

    Texts are read twice, to count and to score. A filter of up to ``limit`` bytes is broadcast. A larger one stays in its
    segments, and the texts' distinct n-grams are sent there (``asked_segments``): same answers, work in proportion to the texts.
    """
    held_out = remainder(id_column, 10) == 0 if held_out is None else held_out
    rows = docs.select(F.col(id_column).alias("doc_id"), held_out.alias("held_out"), whole_text(text_column).alias("text"))
    learned = rows.where(~F.col("held_out"))
    spark, kind = docs.sparkSession, rows.schema["doc_id"].dataType.simpleString()
    size = learned.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    group_bits = max(0, int(np.ceil(np.log2(max(1, size / SEGMENT_BYTES)))))
    segments = stored(filter_segments(learned, group_bits), "filter")
    counts = segments.select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("n")))).where((F.col("n") > 0) & (F.col("word") != np.uint64(word_key(START)).astype(np.int64).item()))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, values = n + ADD * (v + 1), mean_counts(segments)
    often = counts.where(F.col("n") * heavy >= n).toPandas().sort_values("word")
    common = spark.sparkContext.broadcast((often["word"].to_numpy(np.int64), often["n"].to_numpy(np.int64)))
    filter_bytes = segments.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    within = filter_bytes <= limit
    shared = spark.sparkContext.broadcast(whole_filter(segments, group_bits, filter_bytes)) if within else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = common.value
        part = TaskContext.get().partitionId() << 33
        next_row = part
        for chunk in chunks(batches, limit=TEXT_BYTES if within else SENT_BYTES):
            t = tokens(chunk.column(2))
            signed = t.names.view(np.int64)
            at = np.minimum(np.searchsorted(words, signed), max(0, len(words) - 1))
            common_word = words[at] == signed if len(words) else np.zeros(len(signed), bool)
            value = np.zeros(len(signed))
            value[common_word] = np.log10((known[at[common_word]] + ADD) / total)
            hit = common_word[t.words]
            hits = np.add.reduceat(hit.astype(np.int64), t.begins)
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(t.counts - hits)]).astype(np.int32)), pa.array(signed[t.words[~hit]]))
            score = text_scores(t, lambda keys: _asked(shared.value, keys), values, total) if within else np.zeros(len(t.counts))
            found = [chunk.column(0), chunk.column(1), pa.array(next_row + np.arange(len(t.counts))), pa.array(t.counts), pa.array(hits),
                     pa.array(np.add.reduceat(value[t.words], t.begins)), pa.array(score), rare]
            next_row += len(t.counts)
            if within:
                yield pa.RecordBatch.from_arrays(found, SCORED)
                continue
            texts = pa.ListArray.from_arrays(pa.array([0, len(t.counts)], pa.int32()), pa.StructArray.from_arrays(found, SCORED))
            yield pa.RecordBatch.from_arrays([
                pa.array([next_row], pa.int64()), texts, *(pa.array([x.tobytes()], pa.binary()) for x in (t.names, t.words.astype(np.int32), t.counts.astype(np.int32)))],
                ["chunk", "texts", "names", "words", "counts"])

    fields = dict(zip(SCORED, (kind, "boolean", "bigint", "bigint", "bigint", "double", "double", "array<bigint>")))
    if within:
        scored = stored(rows.mapInArrow(run, ", ".join(f"{a} {b}" for a, b in fields.items())), "scored")
    else:
        texts = ",".join(f"{a}:{b}" for a, b in fields.items())
        coded = stored(rows.mapInArrow(run, f"chunk bigint, texts array<struct<{texts}>>, names binary, words binary, counts binary"), "coded-chunks")
        scored = coded.select(F.inline("texts")).drop("score").join(asked_segments(coded, segments, group_bits, values, total), "rid")
    rare = scored.select("rid", F.explode("rare").alias("word")).groupBy("rid", "word").agg(F.count("*").alias("times"))
    found = rare.join(counts.where(F.col("n") * heavy < n), "word", "left")
    seen = F.coalesce("n", F.lit(0))
    sums = found.groupBy("rid").agg(F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.log10((seen + ADD) / F.lit(total))).alias("b"))
    return scored.join(sums, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), "score")


def _asked(part: Filter, keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    found = np.empty(len(keys), np.uint8)
    found[order] = part.levels(keys[order])
    return found
