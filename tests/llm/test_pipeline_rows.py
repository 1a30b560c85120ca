"""Every stage of the pipeline on rows that are nobody's copy, share ids, or have none."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coldtrail.llm import exact_dedup, mixing, quality, simhash

WORDS = "one two three four five six seven eight nine ten eleven twelve".split()


def prose(seed, n=80):
    return " ".join(f"{WORDS[(seed * 7 + k * (seed + 3)) % 12]}{(seed * 131 + k * k) % 89}" for k in range(n))


@pytest.fixture(scope="module")
def five(spark):
    """Five different texts, three without an id, two with id 7."""
    rows = [(None, prose(1)), (None, prose(2)), (None, prose(3)), (7, prose(4)), (7, prose(5))]
    return spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_rows_that_are_nobodys_copy_stay(five):
    assert rows_of(exact_dedup.drop_exact_copies(five)) == rows_of(five)
    assert rows_of(simhash.drop_near_copies(five)) == rows_of(five)
    assert len(rows_of(quality.drop_poor(five))) == sum(r["kept"] for r in quality.quality_rules(five).collect())


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def first(rows):
    return min(rows, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))


def test_exact_dedup_leaves_one_row_of_each_text(odd, documents, clashing):
    for docs in (odd, documents, documents.unionByName(documents.limit(20)), clashing.limit(50), odd.unionByName(odd)):
        rows = docs.collect()
        groups = {}
        for r in rows:
            groups.setdefault(bare(r["text"]), []).append(r)
        got = exact_dedup.drop_exact_copies(docs)
        assert got.columns == docs.columns
        found = got.collect()
        assert Counter(bare(r["text"]) for r in found) == Counter(groups.keys())
        for r in found:
            best = first(groups[bare(r["text"])])
            assert (r["doc_id"], len(r["text"] or "")) == (best["doc_id"], len(best["text"] or "")) and r in rows


def test_exact_dedup_with_colliding_hashes(odd):
    weak = lambda c: F.md5(F.substring(c, 1, 1))
    plain, weaker = (rows_of(exact_dedup.drop_exact_copies(odd, content_hash=h)) for h in (F.md5, weak))
    assert plain == weaker
    assert rows_of(exact_dedup.exact_groups(odd, content_hash=weak)) == rows_of(exact_dedup.exact_groups(odd))


def test_near_dedup_leaves_one_row_of_each_component(odd, documents, clashing):
    for docs in (odd, documents, documents.unionByName(documents.limit(20)), clashing.limit(50), odd.unionByName(odd)):
        prints = {}
        for r in simhash.simhash_groups(docs.withColumn("n_chars", F.lit(0).cast("long"))).collect():
            prints.setdefault(r["fingerprint"], set()).add(r["component_id"])
        parent = {p: p for p in prints}

        def root(p):
            while parent[p] != p:
                p = parent[p]
            return p

        for a in prints:
            for b in prints:
                if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 2:
                    parent[root(b)] = root(a)
        got = simhash.drop_near_copies(docs)
        assert got.columns == docs.columns and got.count() == len({root(p) for p in prints})
        assert all(r in docs.collect() for r in got.collect()[:5])


def test_quality_judges_each_row_that_shares_an_id(spark):
    rows = [(1, prose(9)), (1, "too short"), (None, "short too"), (None, prose(11))]
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["text"] for r in quality.drop_poor(docs).collect()}
    assert kept <= {prose(9), prose(11)}


def test_repeated_documents_keep_columns_of_clashing_names(documents):
    docs = documents.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in mixing.OWN})
    got = mixing.repeated_documents(docs)
    assert got.columns == docs.columns
    assert got.where(" or ".join(f"{c} <> concat('{c}:', doc_id)" for c in mixing.OWN)).isEmpty()
    want = Counter(r["doc_id"] for r in mixing.mix_sources(documents).collect())
    assert Counter(r["doc_id"] for r in got.collect()) == want


@pytest.mark.parametrize("kind", ["odd", "none", "clashing"])
def test_all_stages_on_odd_tables(spark, kind, request):
    docs = request.getfixturevalue(kind)
    docs = docs.limit(30) if kind == "clashing" else docs
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, "")
        rows = result.collect()
        assert kind != "none" or rows == [], name
        if name != "packing":
            assert result.columns == docs.columns, name
