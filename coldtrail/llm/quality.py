"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldtrail.llm.common import BLANKS, chunks, free_name, row_hash, split_words, whole_text
from coldtrail.sources.workspace import stored

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SCALE = 1000  # ratios are sketched in thousandths
LOSS = 0.005  # share of a group's rows that lie beyond its own cutoff of one rule
PULL = 200.0  # rows' weight of the language's quantile beside the group's, and of the whole table's beside the language's
KEPT = 4096  # items of a quantile sketch; its ranks are right to 0.0013 of the rows
#: Rules: name, numerator, denominator, and the side of the cutoff on which rows fail.
RULES = (
    ("symbols", "n_symbols", "n_words", "upper"),
    ("dup_lines", "n_dup_lines", "n_lines", "upper"),
    ("repeats", "n_repeat_words", "n_words", "upper"),
    ("long_words", "word_chars", "n_words", "upper"),
    ("short_words", "word_chars", "n_words", "lower"),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a three-word window found twice or more in that text."""
    totals = np.zeros(len(offsets) - 1, np.int64)
    counts = np.diff(offsets)
    if not len(words) or counts.max() < 4:
        return totals
    ids = words.dictionary_encode().indices.to_numpy().astype(np.uint64)
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    a, b, c, text = ids[:-2], ids[1:-1], ids[2:], owner[:-2]
    inside = np.flatnonzero(text == owner[2:])
    windows = np.stack([text[inside], a[inside], b[inside], c[inside]], axis=1)
    code = windows[:, 0]
    for column, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9)):
        code = (code ^ (code >> np.uint64(29))) * np.uint64(factor) + windows[:, column]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not np.array_equal(windows[order[1:]][same], windows[order[:-1]][same]):  # two windows with one code
        code = np.unique(windows, axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(code, kind="stable")
        same = code[order[1:]] == code[order[:-1]]
    again = np.zeros(len(inside), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    hits = inside[again]
    for step in range(3):
        covered[hits + step] = True
    np.add.at(totals, owner[covered].astype(np.int64), 1)
    return totals


def _counts(text: pa.Array) -> list[np.ndarray]:
    words, offsets = split_words(text, lower=False)
    ends = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)])
    symbols, lines, copies = [], [], []
    for whole in text.to_pylist():
        raw = (whole or "").encode("utf-8", "surrogatepass")
        symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
        full = [line for line in raw.split(b"\n") if line.strip(BLANKS.encode())]
        lines.append(len(full))
        copies.append(len(full) - len(set(full)))
    return [np.diff(offsets), ends[offsets[1:]] - ends[offsets[:-1]], *(np.array(x, np.int64) for x in (symbols, lines, copies)), _repeat_words(words, offsets)]


def with_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows with the counts of ``COUNTS`` (all long) in place of the text."""
    rest = [c for c in docs.columns if c != text_column]
    frame = docs.select(*rest, whole_text(text_column).alias(text_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_column):
            found = _counts(part.column(len(rest)))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *(pa.array(x) for x in found)], [*rest, *COUNTS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name != text_column), *(f"{c} bigint" for c in COUNTS)])
    return frame.mapInArrow(run, schema)


def _ratio(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.floor(F.col(top) * SCALE / F.col(bottom))).cast("bigint")


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, n, one quantile sketch per rule): sketches combine in the map task and again after the shuffle."""
    found = [F.kll_sketch_agg_bigint(_ratio(top, bottom), F.lit(KEPT)).alias(name) for name, top, bottom, _ in RULES]
    return counts.groupBy("lang", "source").agg(F.count("*").alias("n"), *found)


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of larger groups from those of smaller ones."""
    return sketch.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_bigint(F.col(name), F.lit(KEPT)).alias(name) for name, *_ in RULES])


def _quantiles(sketch: DataFrame) -> list[Column]:
    return [F.kll_sketch_get_quantile_bigint(sketch[name], F.lit(LOSS if side == "lower" else 1 - LOSS)) for name, _, _, side in RULES]


def cutoffs(sketch: DataFrame) -> DataFrame:
    """(lang, source, cut_ and one column per rule). A cutoff is the quantile of the group's own sketch, drawn towards that of its
    language, itself drawn towards that of all rows, by a weight of ``PULL`` rows: a group of n rows counts n / (n + PULL)."""
    names = [name for name, *_ in RULES]
    if sketch.isEmpty():
        return sketch.select("lang", "source", *[F.lit(None).cast("double").alias(f"cut_{name}") for name in names])
    pairs = sketch.select("lang", "source", "n", *[q.alias(f"q_{name}") for name, q in zip(names, _quantiles(sketch))])
    langs = merged(sketch, "lang")
    langs = langs.select(F.col("lang").alias("_lang"), F.col("n").alias("_n"), *[q.alias(f"l_{name}") for name, q in zip(names, _quantiles(langs))])
    every = merged(sketch)
    whole = every.select(*[q.alias(f"a_{name}") for name, q in zip(names, _quantiles(every))]).first()
    chosen = pairs.join(langs, pairs["lang"].eqNullSafe(langs["_lang"]))

    def drawn(rows: Column, own: Column, wider: Column) -> Column:
        return (rows * own + PULL * wider) / (rows + PULL)

    return chosen.select("lang", "source", *[
        drawn(F.col("n"), F.col(f"q_{name}"), drawn(F.col("_n"), F.col(f"l_{name}"), F.lit(whole[f"a_{name}"]).cast("double"))).alias(f"cut_{name}") for name in names])


def judged(docs: DataFrame, id_column: str, text_column: str, lang_column: str, source_column: str) -> DataFrame:
    """(doc_id, row, lang, source, counts, base_failed, failed, kept): ``row`` is the hash of the whole row."""
    plain = docs.select(F.col(id_column).alias("doc_id"), row_hash(docs).alias("row"), F.col(lang_column).alias("lang"), F.col(source_column).alias("source"), F.col(text_column).alias("text"))
    counts = with_counts(plain).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    counts = stored(counts, "quality-counts")
    sketch = stored(sketches(counts.where(~F.col("base_failed"))), "sketches")
    cuts = cutoffs(sketch).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = counts.join(cuts, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    broken = []
    for name, top, bottom, side in RULES:
        at, cut = _ratio(top, bottom), F.col(f"cut_{name}")
        broken.append(F.when(at > cut if side == "upper" else at < cut, F.lit(name)))
    joined = joined.withColumn("failed", F.array_join(F.array_compact(F.array(*broken)), ","))
    return joined.select("doc_id", "row", "lang", "source", *COUNTS, "base_failed", "failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"))


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """One row per input row: doc_id, lang, source, the counts, base_failed, failed (names of the adaptive rules that reject it), kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text (null: none). base_failed: under 50 words, or over half of them in
    repeated three-word windows. An adaptive rule rejects rows beyond a cutoff on a ratio: the quantile that leaves
    ``LOSS`` of the rows of the row's language and source beyond it, from a mergeable KLL sketch, small groups drawn
    towards their language and that towards all rows (``cutoffs``). Rows that already failed do not feed the sketches.
    Null languages and sources are groups of their own. Repeated rows count each; a text without words fails the base
    rule; no rows give no rows; other columns are ignored.
    """
    return judged(docs, id_column, text_column, lang_column, source_column).drop("row")


def drop_poor(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """The rows the rules keep, with all their columns; rows that share an id are judged each by its own text."""
    keep = judged(docs, id_column, text_column, lang_column, source_column).where("kept").select(F.col("doc_id").alias("_keep"), F.col("row").alias("_row")).distinct()
    name = free_name(docs, "_hash")
    hashed = docs.withColumn(name, row_hash(docs))
    return hashed.join(keep, hashed[id_column].eqNullSafe(keep["_keep"]) & (hashed[name] == keep["_row"]), "left_semi").drop(name)
