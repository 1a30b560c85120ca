"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds what they miss."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldtrail.llm.common import chunks, passages, split_words, whole_text

#: Patterns, and the least length of a group of the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run's first match is the whole run, so shorter runs need no match
KINDS = ("assign", "access", "hex", "crf")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")

OUT, BEGIN, INSIDE = 0, 1, 2
TEXT_CHARS = 20_000  # code points of a text that the field is fitted on, besides the surroundings of its first matches
NEAR_CHARS, NEAR_HITS = 400, 8
NEAR_WORDS = "password|passwd|secret|token|api_?key|akia[a-z0-9]{16}|[0-9a-f]{24}"
SAMPLE = 800  # rows with and rows without pattern matches that the field is fitted on, at most each
AROUND = 12  # words kept on either side of a secret in training
SHORTEST = 12  # characters of a span that the field may add
#: Neighbours told apart, the absent one last.
NAMED = (
    "password", "passwd", "secret", "token", "apikey", "api_key", "key", "auth", "authorization", "bearer", "credential", "credentials", "passphrase", "access_key",
    "secret_key", "private_key", "")
FEATURES, NEAR = 40, 64  # of a word itself; buckets of a neighbour
LETTERS = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
SEED = 5
SUSPECT = "(?i:pass|secret|token|api)|AKIA|[0-9a-f]{24}"  # every pattern match has this in one word
TEXT_BYTES = 4_000_000
ROUNDS, RATE = 40, 0.15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, sorted by start, then kind; in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _class_counts(words: pa.Array) -> np.ndarray:
    """(words, 6): bytes of each word that are lower, upper, digit, hex letter or digit, of base64 beyond letters and digits, other."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), np.uint8)
    table = np.zeros((256, 6), np.int32)
    for k, group in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"0123456789abcdefABCDEF", b"+/_=-.")):
        table[list(group), k] = 1
    table[:, 5] = table[:, [0, 1, 2, 4]].sum(axis=1) == 0
    if not len(raw):
        return np.zeros((len(words), 6), np.int32)
    return np.add.reduceat(table[raw], np.minimum(np.cumsum(lengths) - lengths, len(raw) - 1), axis=0)


def word_features(words: pa.Array) -> np.ndarray:
    """(words, FEATURES): shape of distinct words: classes of characters, their mix, length, marks, words that name secrets."""
    result = np.zeros((len(words), FEATURES), np.float32)
    if not len(words):
        return result
    n = pc.binary_length(words).to_numpy(zero_copy_only=False)
    counts = _class_counts(words)
    share = counts / np.maximum(n, 1)[:, None]
    low, up, digit, hexed, extra, other = counts.T
    for k, edge in enumerate((4, 8, 12, 16, 20, 24, 32, 40, 64)):
        result[:, k] = n >= edge
    result[:, 9:15] = share
    mixed = (low > 0).astype(int) + (up > 0) + (digit > 0)
    for k, flag in enumerate((
            mixed == 1, mixed == 2, mixed == 3, (hexed >= n - 4) & (n >= 12), digit == n, (digit > 0) & (low + up > 0), other == 0, other > 3,
            (low > 1) & (up > 1) & (digit > 1), (up + digit >= n - 2) & (n >= 16) & (digit > 1), extra > 2, share[:, 2] > 0.15)):
        result[:, 15 + k] = flag
    lowered = pc.ascii_lower(words)
    for k, part in enumerate(("pass", "secret", "token", "key", "auth", "cred", "://", "@", "=", ":", '"', "'")):
        result[:, 27 + k] = pc.match_substring(lowered, part).to_numpy(zero_copy_only=False)
    result[:, 39] = 1
    return result


def near_bucket(words: pa.Array) -> np.ndarray:
    """Bucket of each distinct word as a neighbour: words that name secrets have one each, others go by length."""
    bare = pc.ascii_trim(pc.ascii_lower(words), "\"'`:=.,;()[]{}<>#*$%&|")
    own = pc.fill_null(pc.index_in(bare, value_set=pa.array(NAMED)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.binary_length(bare).to_numpy(zero_copy_only=False)
    return np.where(own >= 0, own, len(NAMED) + np.minimum(sizes, NEAR - len(NAMED) - 1))


def text_features(raw: str, n_words: int) -> list[float]:
    """Of the whole text: length, lines to words, marks of code."""
    marks = sum(raw.count(c) for c in "{};=")
    return [float(n_words > 50), float(n_words > 500), min(1.0, raw.count("\n") / max(1, n_words)), min(1.0, marks / max(1, n_words))]


@dataclass
class Field:
    """Weights of the field: the word's own features, the words before and after, the text, and the transitions."""

    own: np.ndarray
    near: np.ndarray  # (2, NEAR, 3) for the word before and the word after
    text: np.ndarray
    step: np.ndarray  # (3, 3) from the earlier tag; its entry from OUT to INSIDE forbids

    def emissions(self, own: np.ndarray, near: np.ndarray, ids: np.ndarray, before: np.ndarray, after: np.ndarray, text: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """(words, 3). own, near: of distinct words; ids: the words in order; before, after: the neighbours' places or -1; owner: their text."""
        table, sides = own @ self.own, [self.near[k][near] for k in (0, 1)]
        result = table[ids] + (text @ self.text)[owner]
        for side, place in zip(sides, (before, after)):
            result += np.where((place >= 0)[:, None], side[ids[np.maximum(place, 0)]], 0)
        return result


FORBIDDEN = -30.0


def viterbi(scores: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best tags of sequences of one length: scores (sequence, time, 3). A sequence may not begin inside."""
    count, length, _ = scores.shape
    best = scores[:, 0] + np.array([0.0, 0.0, FORBIDDEN])
    back = np.zeros((count, length, 3), np.int64)
    for t in range(1, length):
        ways = best[:, :, None] + step
        back[:, t] = ways.argmax(axis=1)
        best = ways.max(axis=1) + scores[:, t]
    tags = np.zeros((count, length), np.int64)
    tags[:, -1] = best.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        tags[:, t - 1] = back[np.arange(count), t, tags[:, t]]
    return tags


def decode(scores: np.ndarray, begins: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Viterbi tags of many texts (``begins``: where each starts, one entry more).

    A word that must be outside whatever its neighbours are cuts a text: the best path passes OUT there. What lies
    between such words is decoded by dynamic programming, sequences of one length together.
    """
    tags = np.zeros(len(scores), np.int64)
    free = step.copy()
    free[OUT, INSIDE] = np.nan
    first = np.zeros(len(scores), bool)
    first[begins[:-1][begins[:-1] < len(scores)]] = True
    # A tagged word can always turn to OUT if the next, where it is inside, turns to begin: three transitions change.
    turned = np.maximum(0, scores[:, INSIDE] - scores[:, BEGIN])
    turned = np.where(np.append(first[1:], True), 0, np.append(turned[1:], 0))
    reach = 3 * (np.nanmax(free) - np.nanmin(free)) + turned
    open_ = scores[:, OUT] - scores[:, 1:].max(axis=1) <= reach
    starts = np.flatnonzero(open_ & (first | ~np.concatenate([[False], open_[:-1]])))
    if not len(starts):
        return tags
    closed = np.append(np.flatnonzero(~open_ | first), len(scores))
    stops = closed[np.searchsorted(closed, starts, side="right")]
    sizes = stops - starts
    for size in np.unique(sizes):
        own = starts[sizes == size]
        at = own[:, None] + np.arange(size)
        # The words on either side are OUT, or the text ends there.
        block = scores[at].copy()
        lead = ~first[own]
        block[lead, 0] += step[OUT] - np.array([0.0, 0.0, FORBIDDEN])
        after = own + size
        tail = (after < len(scores)) & ~first[np.minimum(after, len(scores) - 1)]
        block[tail, -1] += step[:, OUT]
        tags[at] = viterbi(block, step)
    return tags


def _fit(own: np.ndarray, before: np.ndarray, after: np.ndarray, text: np.ndarray, tags: np.ndarray, mask: np.ndarray) -> Field:
    """Field from sequences (sequence, time): likelihood by forward and backward sums, gradients by Adam."""
    count, length = tags.shape
    weights = {"own": np.zeros((FEATURES, 3)), "near": np.zeros((2, NEAR, 3)), "text": np.zeros((4, 3)), "step": np.zeros((3, 3))}
    weights["step"][OUT, INSIDE] = FORBIDDEN
    m, v = {k: np.zeros_like(w) for k, w in weights.items()}, {k: np.zeros_like(w) for k, w in weights.items()}
    gold = np.eye(3)[tags] * mask[:, :, None]
    gold_step = np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:])
    start = np.array([0.0, 0.0, FORBIDDEN])
    for turn in range(1, ROUNDS + 1):
        scores = own @ weights["own"] + weights["near"][0][before] + weights["near"][1][after] + (text @ weights["text"])[:, None]
        step, forward, backward = weights["step"], np.zeros((count, length, 3)), np.zeros((count, length, 3))
        sums = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
        forward[:, 0] = scores[:, 0] + start
        for t in range(1, length):
            ahead = sums(forward[:, t - 1, :, None] + step, 1) + scores[:, t]
            forward[:, t] = np.where(mask[:, t, None], ahead, forward[:, t - 1])
        whole = sums(forward[:, -1], 1)
        expected_step = np.zeros((3, 3))
        for t in range(length - 2, -1, -1):
            later = step + (scores[:, t + 1] + backward[:, t + 1])[:, None, :]
            backward[:, t] = np.where(mask[:, t + 1, None], sums(later, 2), 0)
            pair = np.exp(forward[:, t, :, None] + later - whole[:, None, None]) * mask[:, t + 1, None, None]
            expected_step += pair.sum(axis=0)
        expected = np.exp(forward + backward - whole[:, None, None]) * mask[:, :, None]
        off = (expected - gold) / count
        grad = {"own": np.einsum("btf,bti->fi", own, off), "text": text.T @ off.sum(axis=1), "step": (expected_step - gold_step) / count, "near": np.zeros((2, NEAR, 3))}
        for k, place in enumerate((before, after)):
            for tag in range(3):
                grad["near"][k, :, tag] = np.bincount(place.ravel(), off[:, :, tag].ravel(), NEAR)
        grad["step"][OUT, INSIDE] = 0
        for name, w in weights.items():
            g = grad[name] + 1e-4 * w * (w > FORBIDDEN)
            m[name], v[name] = 0.9 * m[name] + 0.1 * g, 0.999 * v[name] + 0.001 * g * g
            w -= RATE * (m[name] / (1 - 0.9**turn)) / (np.sqrt(v[name] / (1 - 0.999**turn)) + 1e-8)
    return Field(weights["own"].astype(np.float32), weights["near"].astype(np.float32), weights["text"].astype(np.float32), weights["step"])


def _disguised(words: list[str], tags: list[int], rng: np.random.Generator) -> list[str]:
    """The words with each secret as a random one of the same length, bare, and the word before it as one that names secrets
    otherwise: so the field learns the shape of a secret and not the patterns' own keywords."""
    out = list(words)
    for k, tag in enumerate(tags):
        if tag != OUT:
            out[k] = "".join(rng.choice(LETTERS, max(SHORTEST, len(words[k].strip("\"'")))))
        if tag == BEGIN and k:
            out[k - 1] = str(rng.choice(NAMED[:-1]))
    return out


def fit(texts: list[str]) -> Field | None:
    """A field that learns the patterns' values in their surroundings, and the same number of plain passages; None
    without any match. An access key or hex run, and the value of an assignment, is one secret: its words are tagged
    begin and inside. Each passage with a secret is learned a second time in disguise."""
    examples: list[tuple[list[str], list[int], list[float], list[str]]] = []
    rng = np.random.default_rng(SEED)
    for text in texts:
        secret = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] + [(a, b) for a, k, b in base_spans(text) if k]
        words = [(m.start(), m.end()) for m in WORD.finditer(text)]
        tags = np.zeros(len(words), np.int64)
        ends = np.array([b for _, b in words])
        for a, b in secret:
            k = int(np.searchsorted(ends, a, side="right"))
            tags[k] = BEGIN if tags[k] == OUT else tags[k]
            while k + 1 < len(words) and words[k + 1][0] < b:
                k += 1
                tags[k] = INSIDE
        strings, features = [text[a:b] for a, b in words], text_features(text, len(words))
        hits = np.flatnonzero(tags == BEGIN)
        spots = hits.tolist() or list(range(AROUND, len(words), max(2 * AROUND, len(words) // 4)))[:4]
        for spot in spots:
            low = max(0, spot - AROUND)
            if tags[low] == INSIDE:
                low = int(np.flatnonzero(tags[:low] == BEGIN)[-1])
            high = min(len(words), spot + AROUND)
            edge = ["" if low == 0 else strings[low - 1], "" if high == len(words) else strings[high]]
            own = tags[low:high].tolist()
            examples.append((strings[low:high], own, features, edge))
            if BEGIN in own:
                examples.append((_disguised(strings[low:high], own, rng), own, features, edge))
    if not any(BEGIN in tags for _, tags, _, _ in examples):
        return None
    longest = min(4 * AROUND, max(len(w) for w, *_ in examples))
    count = len(examples)
    flat = list(dict.fromkeys(w for words, _, _, edge in examples for w in [*words, *edge]))
    index = {w: i for i, w in enumerate(flat)}
    table, bucket = word_features(pa.array(flat, pa.string())), near_bucket(pa.array(flat, pa.string()))
    own, tags, mask = np.zeros((count, longest, FEATURES), np.float32), np.zeros((count, longest), np.int64), np.zeros((count, longest), bool)
    before, after = np.zeros((count, longest), np.int64), np.zeros((count, longest), np.int64)
    for b, (words, own_tags, _, edge) in enumerate(examples):
        words, own_tags = words[:longest], own_tags[:longest]
        around = [edge[0], *words, edge[1]]
        n, ids = len(words), [index[w] for w in words]
        own[b, :n], tags[b, :n], mask[b, :n] = table[ids], own_tags, True
        before[b, :n], after[b, :n] = bucket[[index[w] for w in around[:n]]], bucket[[index[w] for w in around[2:n + 2]]]
    return _fit(own, before, after, np.array([f for _, _, f, _ in examples]), tags, mask)


def find_spans(texts: list[str], field: Field | None) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int]]]]:
    """Per text, the patterns' spans, and the spans the field tags as secrets, without quotes and marks around them."""
    base: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    result: list[list[tuple[int, int]]] = [[] for _ in texts]
    words, offsets = split_words(pa.array(texts, pa.string()), lower=False)
    if not len(words):
        return base, result
    coded = words.dictionary_encode()
    ids, counts = coded.indices.to_numpy().astype(np.int64), np.diff(offsets)
    owner, place = np.repeat(np.arange(len(texts)), counts), np.arange(len(ids))
    suspect = pc.match_substring_regex(coded.dictionary, SUSPECT).to_numpy(zero_copy_only=False)
    for k in np.unique(owner[suspect[ids]]):
        base[k] = base_spans(texts[k])
    if field is None:
        return base, result
    before = np.where(place > offsets[owner], place - 1, -1)
    after = np.where(place + 1 < offsets[owner + 1], place + 1, -1)
    feature = np.array([text_features(t, int(n)) for t, n in zip(texts, counts)], np.float32)
    scores = field.emissions(word_features(coded.dictionary), near_bucket(coded.dictionary), ids, before, after, feature, owner)
    edge = field.near[:, len(NAMED) - 1].astype(np.float32)  # the bucket of an empty neighbour, as in training
    scores[before < 0] += edge[0]
    scores[after < 0] += edge[1]
    tags = decode(scores.astype(np.float64), offsets, field.step)
    for k in np.unique(owner[tags > 0]):
        own = tags[offsets[k]: offsets[k + 1]]
        where = [(m.start(), m.end()) for m in WORD.finditer(texts[k])]
        for i in np.flatnonzero(own == BEGIN):
            j = int(i)
            while j + 1 < len(own) and own[j + 1] == INSIDE:
                j += 1
            values = list(VALUE.finditer(texts[k], where[i][0], where[j][1]))
            value = max(values, key=lambda m: m.end() - m.start(), default=None)
            if value is not None and value.end() - value.start() >= SHORTEST:
                result[k].append((value.start(), value.end()))
    return base, result


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id and spans array<struct<kind, start, stop>> by start, then kind (assign, access, hex, crf).

    Pattern matches are kept as they are; the field adds spans that overlap none of them. It is fitted on at most
    ``sample`` rows with and as many without a match, in the order of a hash of the id, cut by the executors to ``TEXT_CHARS``
    code points and the surroundings of the first matches; training passages are cut at 48 words. Spans count code points of the
    whole text, the end exclusive. Null and empty texts have no spans; repeated rows and null ids come back as they are;
    other columns are ignored; no rows give no rows; without any match in the table the field adds nothing.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    lowered = F.lower("text")
    rough = F.col("text").contains("AKIA") | F.col("text").rlike("[0-9a-f]{24}")
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        rough = rough | lowered.contains(word)
    marked = rows.select("doc_id", rough.alias("hit"))
    ids = [marked.where(F.col("hit") == hit).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for hit in (True, False)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]).select("doc_id").distinct())
    near = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"(?is).{{0,{NEAR_CHARS}}}(?:{NEAR_WORDS}).{{0,{NEAR_CHARS}}}"), 0), 1, NEAR_HITS), "\n")
    short = F.when(F.length("text") <= TEXT_CHARS, F.col("text")).otherwise(F.concat_ws("\n", near, passages(F.col("text"), TEXT_CHARS)))
    texts = rows.join(chosen, "doc_id").select("doc_id", short.alias("text")).groupBy("doc_id").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    field = docs.sparkSession.sparkContext.broadcast(fit(texts["text"].tolist()))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=TEXT_BYTES):
            whole = part.column(1).to_pylist()
            result = []
            for spans, more in zip(*find_spans(whole, field.value)):
                added = [(a, 3, b) for a, b in more if all(b <= s or e <= a for s, _, e in spans)]
                result.append([{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in sorted(spans + added)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(result, pa.list_(pa.struct({"kind": pa.string(), "start": pa.int64(), "stop": pa.int64()})))], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,stop:bigint>>")
