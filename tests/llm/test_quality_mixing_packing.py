from __future__ import annotations

import re
import zlib
from collections import Counter

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coldtrail.llm import mixing, packing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), copies, len(covered)


def test_counts_and_base_rule(documents, odd, clashing):
    for docs in (documents, odd, clashing):
        texts = sorted([(r["doc_id"], *counts_by_hand(r["text"])) for r in docs.collect()], key=repr)
        rows = quality.quality_rules(docs).collect()
        assert sorted([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows], key=repr) == texts
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["base_failed"] and r["kept"]) and r["kept"] == (not r["base_failed"] and r["failed"] == "")


def at_rank(values, share):
    return sorted(values)[max(0, math.ceil(len(values) * share - 1e-9) - 1)]


def test_adaptive_verdicts_equal_brute_force(documents, odd):
    for docs in (documents, odd):
        rows = quality.quality_rules(docs).collect()
        ratio = lambda r, top, bottom: r[top] * 1000 // r[bottom]
        fair = [r for r in rows if not r["base_failed"]]
        for r in rows:
            same = [x for x in fair if (x["lang"], x["source"]) == (r["lang"], r["source"])]
            lang = [x for x in fair if x["lang"] == r["lang"]]
            failed = []
            for name, top, bottom, side in quality.RULES:
                if not same or not r[bottom]:
                    continue
                cut = None
                for group in (fair, lang, same):
                    own = at_rank([ratio(x, top, bottom) for x in group], quality.LOSS if side == "lower" else 1 - quality.LOSS)
                    cut = own if cut is None else (len(group) * own + quality.PULL * cut) / (len(group) + quality.PULL)
                value = ratio(r, top, bottom)
                if value > cut if side == "upper" else value < cut:
                    failed.append(name)
            assert r["failed"] == ",".join(failed), r["doc_id"]


def test_sketches_merge_in_any_order_within_their_error(spark):
    counts = spark.range(60000).selectExpr("'en' as lang", "'a' as source", "id % 7 as part", "1000L as n_words", "1L as n_lines", "0L as n_dup_lines", "0L as n_repeat_words",
                                           "pmod(xxhash64(id), 100000) as n_symbols", "id as word_chars")
    truth = sorted(r[0] for r in counts.select("n_symbols").collect())
    for order in ("part", "part desc", "pmod(part * 3, 7)"):
        sketch = quality.sketches(counts.withColumn("source", F.col("part").cast("string"))).repartition(3).sortWithinPartitions(F.expr("cast(source as int) % 2"), "source" if order == "part" else F.expr(order.replace("part", "cast(source as int)").replace(" desc", " * -1")))
        whole = quality.merged(sketch, "lang").select(F.kll_sketch_get_quantile_bigint("symbols", F.lit(0.995)), "n").first()
        rank = np.searchsorted(truth, whole[0], side="right") / len(truth)
        assert whole[1] == 60000 and abs(rank - 0.995) < 0.003


def test_cutoffs_differ_by_group_in_every_rule(spark):
    rows = []
    for k, (lang, source) in enumerate([("en", "a"), ("en", "b"), ("de", "a")]):
        for i in range(1500):
            noisy = i % (10 + 20 * k) == 0
            words = [("w" * (2 + k + i % 3)) + str((i * 31 + j * (17 + k)) % 997) for j in range(60)]
            lines = [" ".join(words[a:a + 6]) for a in range(0, 60, 6)]
            if noisy:
                lines += lines[:1 + k % 2] + ["# " * (3 + 2 * k)] + [f"extra{j} line" for j in range(k * 2)]
            rows.append((len(rows), "\n".join(lines), lang, source, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    judged = quality.quality_rules(docs)
    fair = judged.where("not base_failed")
    cuts = quality.cutoffs(quality.sketches(fair)).collect()
    for name, *_ in quality.RULES:
        assert len({round(r[f"cut_{name}"], 6) for r in cuts}) == 3, name
    lost = {(r["lang"], r["source"]): r["lost"] for r in fair.groupBy("lang", "source").agg(F.avg(F.when(F.col("kept"), 0.0).otherwise(1.0)).alias("lost")).collect()}
    assert all(share <= 5 * quality.LOSS + 0.01 for share in lost.values()), lost


def test_quality_empty(none):
    assert quality.quality_rules(none).count() == 0
    assert quality.drop_poor(none).columns == none.columns


def test_repeat_words_with_equal_codes(monkeypatch):
    import pyarrow as pa

    text = "a b c d a b c x y z a b"
    words = pa.array(text.split())
    assert quality._repeat_words(words, np.array([0, len(words)])).tolist() == [counts_by_hand(text)[-1]]


def test_mixing_reaches_the_target_and_is_repeatable(documents, none, odd):
    once, again = mixing.mix_sources(documents), mixing.mix_sources(documents.repartition(5))
    key = lambda frame: sorted((r["doc_id"], r["copy"], r["copies"]) for r in frame.collect())
    assert key(once) == key(again)
    assert mixing.mix_sources(none).count() == 0
    assert {r["copies"] for r in mixing.mix_sources(odd, weights={"a": 1.0}, epochs=0.0).collect()} == set()
    sizes = {r["source"]: r["count"] for r in documents.groupBy("source").count().collect()}
    weights = {s: (3.0 if i % 2 else 1.0) for i, s in enumerate(sorted(sizes))}
    got = Counter(r["source"] for r in mixing.mix_sources(documents, weights=weights, epochs=30.0).collect())
    whole, parts = 30 * sum(sizes.values()), sum(weights.values())
    for s in sizes:
        want = whole * weights[s] / parts
        assert abs(got[s] - want) < 6 * np.sqrt(want)


def test_mixing_nulls_and_clashing_columns(odd, clashing):
    rows = mixing.mix_sources(odd, epochs=20.0).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, None, 7, 8, 9}
    assert len([r for r in rows if r["doc_id"] == 8]) == 2 * max(r["copies"] for r in rows if r["doc_id"] == 8)
    assert mixing.mix_sources(clashing).count() > 0


@pytest.mark.parametrize("rate", [0.01, 0.7, 3.0, 40.0, 900.0])
def test_poisson_distribution(spark, rate):
    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(rate)).alias("c")).first()["c"]
    mass = np.diff([0, *cdf])
    assert abs(cdf[-1] - 1) < 1e-9 and abs((mass * np.arange(len(cdf))).sum() - rate) < 1e-6 * max(1, rate)


def ids_by_hand(text):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    if not hasattr(ids_by_hand, "tokenizer"):
        ids_by_hand.tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return np.array(ids_by_hand.tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def check_packing(docs, rows, window=1024):
    spent = sorted([(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows], key=repr)
    wanted = []
    for r in docs.collect():
        ids = ids_by_hand(r["text"])
        wanted += [(r["doc_id"], a, len(ids[a:a + window]), zlib.crc32(ids[a:a + window].tobytes()), len(ids)) for a in range(0, len(ids), window)]
    assert spent == sorted(wanted, key=repr)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    pad = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        pad += packing.padding(at, window)
    return pad / sum(r["length"] for r in rows)


def test_packing_is_a_whole_round_trip_with_little_padding(documents, odd, none):
    assert check_packing(documents, packing.pack(documents).collect()) < 0.05
    check_packing(odd, packing.pack(odd).collect())
    check_packing(odd, packing.pack(odd, window=64).collect(), 64)
    assert packing.pack(none).count() == 0


def test_packed_ids_and_clashing_columns(clashing):
    for r in packing.pack(clashing, with_ids=True).collect():
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "a b", " lead", "trail ", "I'm don't 12 34", "tab\tand\n\nlines \n x", " nbsp  em", "a <|endoftext|> b", "日本語 text", "\U0001F600 x \U0001F600"])
def test_encoder_equals_the_tokenizer(text):
    import pyarrow as pa

    ids, offsets = packing.encoder("byte_bpe_50k").encode(pa.array([text, None, text + " more words"]))
    assert ids[: offsets[1]].tolist() == ids_by_hand(text).tolist()
    assert ids[offsets[1]: offsets[2]].tolist() == [0]
    assert ids[offsets[2]:].tolist() == ids_by_hand(text + " more words").tolist()


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(5)
    for window in (8, 64, 1024):
        histogram = rng.integers(0, 50, window + 1) * (rng.random(window + 1) < 0.6)
        histogram[0] = 0
        used = np.zeros_like(histogram)
        for pattern, n in packing.plan(histogram):
            assert sum(pattern) <= window
            for length in pattern:
                used[length] += n
        assert (used == histogram).all()


def test_words_are_encoded_one_by_one_where_the_stream_does_not_split(monkeypatch):
    coder = packing.encoder("byte_bpe_50k")
    words = ["alpha", "", "beta,", "Ünïcode", "gamma" * 30]
    want = [coder.fast.encode_ordinary(" " + w) for w in words]
    for begins in (coder.begins, np.zeros_like(coder.begins)):  # as it is, and as if no id began with a blank
        monkeypatch.setattr(coder, "begins", begins)
        stream, first = coder.in_one_go(words)
        assert [stream[a:b].tolist() for a, b in zip(first, first[1:])] == want
