"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldtrail.llm.common import chunks, passages, remainder, split_words, whole_text

WINDOW, STRIDE = 24, 16  # words
TEXT_CHARS = 40_000  # code points of a text that the model is fitted on, at most
PER_CLASS = 1500  # labelled rows of each class the model is fitted on, at most
CALIBRATION = 4  # of these, every fourth row calibrates the score and does not train the network
TRAIN_WINDOWS = 12  # windows a training row gives at first, spread evenly over it
ROUNDS = 2  # times that the windows are chosen anew by the network's own scores
WORDS, GRAMS, LEAST = 30_000, 60_000, 4  # vocabulary taken from the training rows, and the rows it must occur in
EDGES = ".,;:!?\"'()[]"  # not part of a word
WIDE, HIDDEN = 8, 8
EPOCHS, BATCH, RATE = 2, 256, 0.01
SLICE = 40_000  # words whose pieces are looked up together
TEXT_BYTES = 8_000_000
BLOCK = 4096  # windows scored together


def piece_codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All runs of three or four bytes of the words, set between marks, as numbers; and the word each belongs to."""
    marked = pc.binary_join_element_wise("^", words.cast(pa.string()), "$", "") if len(words) else words.cast(pa.string())
    ends = np.cumsum(pc.binary_length(marked).to_numpy(zero_copy_only=False).astype(np.int64))
    raw = np.frombuffer("".join(marked.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    codes, owners, code = [], [], raw
    for n in range(2, 5):
        code = (code[:-1] << np.uint64(8)) | raw[n - 1:] if len(raw) >= n else raw[:0]
        if n > 2:
            inside = owner[:len(code)] == owner[n - 1:] if len(code) else np.zeros(0, bool)
            codes.append(code[inside] | np.uint64(n << 40))
            owners.append(owner[:len(code)][inside])
    return np.concatenate(codes), np.concatenate(owners)


def _place(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """1 + place of each wanted value, 0 where it is missing."""
    if not len(sorted_values):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[at] == wanted, at + 1, 0)


@dataclass
class Inputs:
    """Words and character pieces the network knows, and their vectors. Number 0 of either stands for all others."""

    words: pa.Array
    pieces: np.ndarray
    word_vectors: np.ndarray = field(default=None)
    piece_vectors: np.ndarray = field(default=None)

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its number, and its known pieces: owner and number, flat, in the order of words."""
        known = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        codes, owner = piece_codes(words)
        piece = _place(self.pieces, codes)
        owner, piece = owner[piece > 0], piece[piece > 0]
        order = np.argsort(owner, kind="stable")
        return known, owner[order], piece[order]

    def vectors(self, known: np.ndarray, owner: np.ndarray, piece: np.ndarray, count: int) -> np.ndarray:
        """Word vector beside the summed piece vectors over the root of their number."""
        result = np.zeros((count, 2 * WIDE), np.float32)
        result[:, :WIDE] = self.word_vectors[known]
        for k in range(WIDE):
            result[:, WIDE + k] = np.bincount(owner, self.piece_vectors[piece, k], count)
        result[:, WIDE:] /= np.sqrt(np.maximum(np.bincount(owner, minlength=count), 1))[:, None]
        return result


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def forward(net: dict[str, np.ndarray], side: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (time, window, HIDDEN) of one direction from its projected inputs (time, window, 3 HIDDEN)."""
    length, count, _ = x.shape
    h, states, saved = np.zeros((count, HIDDEN), np.float32), np.empty((length, count, HIDDEN), np.float32), []
    gate, new = net[f"gate_{side}"], net[f"new_{side}"]
    for t in range(length) if side == "l" else range(length - 1, -1, -1):
        g = _sigmoid(x[t, :, : 2 * HIDDEN] + h @ gate)
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        inner = h @ new
        n = np.tanh(x[t, :, 2 * HIDDEN:] + r * inner)
        if keep:
            saved.append((t, h, z, r, inner, n))
        h = n + z * (h - n)
        states[t] = h
    return states, saved


def pool(net: dict[str, np.ndarray], states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention over time: logits, weights, pooled states."""
    score = np.where(mask, states @ net["attend"], np.float32(-30.0))
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    return pooled @ net["out"] + net["bias"][0], weight, pooled


def _fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    net = {"attend": rng.normal(0, 0.1, 2 * HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
    for side in "lr":
        net |= {f"in_{side}": rng.normal(0, 0.3, (2 * WIDE, 3 * HIDDEN)), f"plus_{side}": np.zeros(3 * HIDDEN),
                f"gate_{side}": rng.normal(0, 0.3, (HIDDEN, 2 * HIDDEN)), f"new_{side}": rng.normal(0, 0.3, (HIDDEN, HIDDEN))}
    return {k: v.astype(np.float32) for k, v in net.items()}


def gradients(net: dict[str, np.ndarray], vectors: np.ndarray, ids: np.ndarray, mask: np.ndarray, target: np.ndarray):
    """Loss gradients of a batch: of the network's arrays and of the words' vectors. ids, mask: (time, window)."""
    grad = {k: np.zeros_like(v) for k, v in net.items()}
    x, saved, both = vectors[ids], {}, []
    for side in "lr":
        states, saved[side] = forward(net, side, x @ net[f"in_{side}"] + net[f"plus_{side}"], True)
        both.append(states)
    states = np.concatenate(both, axis=2)
    logit, attention, pooled = pool(net, states, mask)
    d_logit = ((_sigmoid(logit) - target) / len(target)).astype(np.float32)
    grad["out"], grad["bias"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
    d_pooled = d_logit[:, None] * net["out"]
    d_attention = (states * d_pooled).sum(axis=2)
    d_score = attention * (d_attention - (attention * d_attention).sum(axis=0))
    grad["attend"] = np.einsum("tbh,tb->h", states, d_score)
    d_states = attention[:, :, None] * d_pooled + d_score[:, :, None] * net["attend"]
    dx = np.zeros_like(x)
    for k, side in enumerate("lr"):
        dh, da = np.zeros((ids.shape[1], HIDDEN), np.float32), np.zeros((*ids.shape, 3 * HIDDEN), np.float32)
        for t, h, z, r, inner, n in reversed(saved[side]):
            dh = dh + d_states[t, :, k * HIDDEN: (k + 1) * HIDDEN]
            dn, dz = dh * (1 - z) * (1 - n * n), dh * (h - n) * z * (1 - z)
            dr, d_inner = dn * inner * r * (1 - r), dn * r
            gates = np.concatenate([dz, dr], axis=1)
            grad[f"gate_{side}"] += h.T @ gates
            grad[f"new_{side}"] += h.T @ d_inner
            da[t] = np.concatenate([gates, dn], axis=1)
            dh = dh * z + gates @ net[f"gate_{side}"].T + d_inner @ net[f"new_{side}"].T
        flat = da.reshape(-1, 3 * HIDDEN)
        grad[f"in_{side}"], grad[f"plus_{side}"] = x.reshape(-1, 2 * WIDE).T @ flat, flat.sum(axis=0)
        dx += da @ net[f"in_{side}"].T
    return grad, dx


class _Adam:
    def __init__(self) -> None:
        self.m, self.v, self.t = {}, {}, 0

    def step(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * grad
        v = self.v[name] = 0.999 * self.v.get(name, 0) + 0.001 * grad * grad
        value -= (RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-6)).astype(np.float32)


def window_starts(n: int) -> np.ndarray:
    """Starts of a text's overlapping windows: every ``STRIDE`` words until the end is covered; one window at least."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


@dataclass
class Model:
    inputs: Inputs
    net: dict[str, np.ndarray]
    scale: np.ndarray  # of the calibration: largest window logit, log of the number of windows, constant

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of the texts, and where each text's windows begin (one entry more)."""
        words, offsets = split_words(texts, lower=True)
        coded = words.dictionary_encode()
        known = pc.ascii_trim(coded.dictionary, EDGES)
        slices = [known.slice(a, SLICE) for a in range(0, len(known), SLICE)]
        vectors = [self.inputs.vectors(*self.inputs.numbers(part), len(part)) for part in slices]
        vectors = np.concatenate([*vectors, np.zeros((1, 2 * WIDE), np.float32)])  # the last stands for padding
        ids = np.append(coded.indices.to_numpy().astype(np.int64), len(known))
        sizes = np.diff(offsets)
        counts = np.maximum(1, -(-(sizes - WINDOW + STRIDE) // STRIDE))
        text = np.repeat(np.arange(len(sizes)), counts)
        first = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE + offsets[text]
        stop = offsets[text + 1]
        projected = {side: vectors @ self.net[f"in_{side}"] + self.net[f"plus_{side}"] for side in "lr"}
        result = np.empty(len(text), np.float32)
        for a in range(0, len(text), BLOCK):
            at = first[a:a + BLOCK] + np.arange(WINDOW)[:, None]
            mask = at < stop[a:a + BLOCK]
            own = ids[np.where(mask, at, len(ids) - 1)]
            states = np.concatenate([forward(self.net, side, projected[side][own], False)[0] for side in "lr"], axis=2)
            result[a:a + BLOCK] = pool(self.net, states, mask)[0]
        return result, np.concatenate([[0], np.cumsum(counts)])

    def window_logits(self, words: pa.Array, windows: np.ndarray) -> np.ndarray:
        """Logits of windows (window, time) of word places, -1 for padding."""
        distinct, ids = np.unique(windows, return_inverse=True)
        own = words.take(pa.array(np.maximum(distinct, 0)))
        vectors = self.inputs.vectors(*self.inputs.numbers(own), len(own))
        mask = windows.T >= 0
        states = [forward(self.net, side, (vectors @ self.net[f"in_{side}"] + self.net[f"plus_{side}"])[ids.reshape(windows.shape).T], False)[0] for side in "lr"]
        return pool(self.net, np.concatenate(states, axis=2), mask)[0]

    def features(self, texts: pa.Array) -> np.ndarray:
        logit, offsets = self.logits(texts)
        counts = np.diff(offsets)
        return np.stack([np.maximum.reduceat(logit, offsets[:-1]), np.log(counts), np.ones(len(counts))], axis=1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _sigmoid((self.features(texts) @ self.scale).astype(np.float64))


def _calibrated(features: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logistic regression by damped Newton steps, with a pull to the plain logit. The network's logit keeps its sign."""
    start, pull = np.array([1.0, 0.0, 0.0]), np.array([1.0, 4.0, 0.2])
    w = start.copy()

    def loss(x: np.ndarray) -> float:
        margin = features @ x
        return float((np.logaddexp(0, margin) - target * margin).sum() + 0.5 * (pull * (x - start) ** 2).sum())

    for _ in range(40):
        p = _sigmoid(features @ w)
        h = features.T @ (features * (p * (1 - p))[:, None]) + np.diag(pull)
        step, size = np.linalg.solve(h, features.T @ (p - target) + pull * (w - start)), 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    w[0] = max(w[0], 0.05)
    return w


def fit(texts: list[str], labels: list[int], seed: int = 3) -> Model:
    """A model from labelled texts; windows carry their text's label."""
    rng = np.random.default_rng(seed)
    words, offsets = split_words(pa.array(texts, pa.string()), lower=True)
    coded = pc.ascii_trim(words, EDGES).dictionary_encode()
    vocabulary, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    rows = [ids[a:b] for a, b in zip(offsets, offsets[1:])]
    spread = np.bincount(np.concatenate([np.unique(r) for r in rows] or [ids]), minlength=len(vocabulary))  # rows that hold a word
    often = np.flatnonzero(spread >= LEAST)
    often = often[np.argsort(-spread[often], kind="stable")][:WORDS]
    codes, owner = piece_codes(vocabulary)
    distinct, place = np.unique(codes, return_inverse=True)
    times = np.bincount(place, spread[owner], len(distinct))
    frequent = np.flatnonzero(times >= LEAST)
    frequent = frequent[np.argsort(-times[frequent], kind="stable")][:GRAMS]
    inputs = Inputs(vocabulary.take(pa.array(often)), np.sort(distinct[frequent]))
    inputs.word_vectors = rng.normal(0, 0.1, (len(inputs.words) + 1, WIDE)).astype(np.float32)
    inputs.piece_vectors = rng.normal(0, 0.1, (len(inputs.pieces) + 1, WIDE)).astype(np.float32)
    inputs.word_vectors[0] = inputs.piece_vectors[0] = 0
    net, adam = _fresh(rng), _Adam()
    model = Model(inputs, net, np.array([1.0, 0.0, 0.0]))
    if len(set(labels)) < 2:
        net["bias"][0] = 4.0 if labels and labels[0] else -4.0
        net["out"][:] = 0
        return model
    known, owner, piece = inputs.numbers(vocabulary)
    bounds = np.searchsorted(owner, np.arange(len(vocabulary) + 1))
    trained = [k for k in range(len(rows)) if k % CALIBRATION != CALIBRATION - 1]
    cut = [np.stack([np.pad(rows[k][i:i + WINDOW], (0, max(0, i + WINDOW - len(rows[k]))), constant_values=-1) for i in window_starts(len(rows[k]))]) for k in trained]
    for turn in range(1 + ROUNDS):
        if turn:  # the windows that speak most for toxicity: of a toxic text the better third, of a clean one the worst and a few others
            order = [np.argsort(-model.window_logits(vocabulary, w)) for w in cut]
            picks = [o[: -(-len(o) // 3)] if labels[k] else np.concatenate([o[:4], o[4::max(1, len(o) // 4)][:4]]) for o, k in zip(order, trained)]
        else:
            picks = [np.unique(np.linspace(0, len(w) - 1, min(len(w), TRAIN_WINDOWS)).astype(int)) for w in cut]
        windows = np.concatenate([w[p] for w, p in zip(cut, picks)])
        target = np.repeat(np.array([labels[k] for k in trained], np.float32), [len(p) for p in picks])
        for _ in range(EPOCHS):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), BATCH):
                pick = order[a:a + BATCH]
                batch = windows[pick].T
                distinct, ids = np.unique(batch, return_inverse=True)
                ids = ids.reshape(batch.shape)
                pad = len(distinct) if distinct[0] >= 0 else 0
                if pad == 0:
                    distinct = distinct[1:]
                    ids = np.where(ids == 0, len(distinct), ids - 1)
                sizes = bounds[distinct + 1] - bounds[distinct]
                flat = np.repeat(bounds[distinct] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                mine, pieces = np.repeat(np.arange(len(distinct)), sizes), piece[flat]
                hidden = np.where(rng.random(len(distinct)) < 0.3, 0, known[distinct])  # words left out at times, so that pieces learn too
                vectors = np.concatenate([inputs.vectors(hidden, mine, pieces, len(distinct)), np.zeros((1, 2 * WIDE), np.float32)])
                grad, dx = gradients(net, vectors, ids, batch >= 0, target[pick])
                adam.t += 1
                for name, g in grad.items():
                    adam.step(name, net[name], np.clip(g, -1, 1))
                flat_ids, flat_dx = ids.ravel(), dx.reshape(-1, 2 * WIDE)
                per = np.stack([np.bincount(flat_ids, flat_dx[:, k], len(distinct) + 1)[:-1] for k in range(2 * WIDE)], axis=1)
                words = np.zeros_like(inputs.word_vectors)
                np.add.at(words, hidden, per[:, :WIDE].astype(np.float32))
                part = (per[:, WIDE:] / np.sqrt(np.maximum(sizes, 1))[:, None])[mine]
                parts = np.stack([np.bincount(pieces, part[:, k], len(inputs.piece_vectors)) for k in range(WIDE)], axis=1)
                words[0] = parts[0] = 0
                for name, value, g in (("words", inputs.word_vectors, words), ("pieces", inputs.piece_vectors, parts.astype(np.float32))):
                    adam.step(name, value, g)
    held = [k for k in range(len(rows)) if k % CALIBRATION == CALIBRATION - 1]
    if len({labels[k] for k in held}) == 2:
        feature = np.concatenate([model.features(pa.array([texts[k] for k in held[a:a + 64]], pa.string())) for a in range(0, len(held), 64)])
        model.scale = _calibrated(feature, np.array([labels[k] for k in held], float))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, per_class: int, most: int = TEXT_CHARS) -> tuple[list[str], list[int]]:
    """Texts and labels to fit on, the first ``per_class`` of each class in the order of a hash of the id, mixed. Of several labels of
    an id the largest counts, of several rows of an id the least text. Executors cut longer texts to passages of ``most`` code points, so that the driver gets at
    most 2 * per_class * most of them."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    known = known.where(remainder("id", 5) != 0).groupBy("id").agg(F.max("label").alias("label"))
    ids = [known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class) for label in (0, 1)]
    texts = docs.select(F.col(id_column).alias("id"), passages(whole_text(text_column), most).alias("text"))
    rows = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = rows.withColumn("order", F.xxhash64("id")).toPandas().sort_values(["order", "id"])
    return rows["text"].tolist(), rows["label"].tolist()


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_windows.

    All overlapping windows of ``WINDOW`` words of the whole text are scored; the largest window logit and the number of
    windows are calibrated to a probability. Fitted on at most ``per_class`` labelled rows of each class outside the
    hold-out (crc32 of the id modulo 5); a class without rows gives a constant. Null and empty texts are one window of
    padding; repeated rows score alike; rows without a label, null labels and null ids are scored, never learned from;
    other columns are ignored; no rows give no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(*training_rows(docs, labels, id_column, text_column, label_column, per_class)))
    rows = docs.select(F.col(id_column).alias("doc_id"), (remainder(id_column, 5) == 0).alias("held_out"), whole_text(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=TEXT_BYTES):
            features = model.value.features(part.column(2))
            score = _sigmoid(features @ model.value.scale)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(np.rint(np.exp(features[:, 1])).astype(np.int64))],
                ["doc_id", "held_out", "score", "predicted", "n_windows"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_windows bigint")
