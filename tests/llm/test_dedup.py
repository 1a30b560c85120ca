from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from coldtrail.llm import exact_dedup, simhash
from coldtrail.llm.components import components


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def exact_by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(bare(r["text"]), []).append(r)
    result = []
    for members in groups.values():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        result += [(r["doc_id"], best["doc_id"], len(members), r["doc_id"] == best["doc_id"]) for r in members]
    return sorted(result, key=repr)


def exact_rows(frame):
    return sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in frame.collect()], key=repr)


def test_exact_groups_equal_brute_force(documents, odd, clashing):
    for docs in (documents, odd, clashing):
        assert exact_rows(exact_dedup.exact_groups(docs)) == exact_by_hand(docs.collect())


def test_collisions_are_told_apart(odd):
    weak = exact_dedup.exact_groups(odd, content_hash=lambda c: F.substring(F.md5(c), 1, 1).substr(1, 0))
    assert exact_rows(weak) == exact_by_hand(odd.collect())


def test_exact_empty_and_kept_rows(none, odd):
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 7, 8, 9]


def fingerprint_by_hand(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k:k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array([p for _, p in prints], np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ v) <= 2):
            root[find(i)] = find(int(j))
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted([(doc, f"{p:016x}", least.get(find(i))) for i, (doc, p) in enumerate(prints)], key=repr)


def test_simhash_equals_brute_force(documents, odd, clashing):
    for docs in (documents, odd, clashing):
        got = sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()], key=repr)
        assert got == groups_by_hand([(r["doc_id"], fingerprint_by_hand(r["text"])) for r in docs.collect()])


def test_simhash_empty(none):
    assert simhash.simhash_groups(none).count() == 0


def test_links_connect_the_same_prints_through_small_and_large_buckets(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for center in list(prints)[:6]:  # chains and dense clusters around a few prints
        walk = center
        for _ in range(60):
            for _ in range(rng.choice((1, 2, 2, 3))):
                walk ^= 1 << rng.randrange(64)
            prints.add(walk)
            walk = walk if rng.random() < 0.7 else center
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in sorted(prints)]
    frame = spark.createDataFrame(signed, "fp bigint")
    expected = groups_by_hand([(s[0], s[0] % (1 << 64)) for s in signed])
    for paired in (2, 3, 32):
        roots = {r["node"]: r["root"] for r in components(simhash.links_within_two_bits(frame, paired)).collect()}
        assert sorted([(s[0], f"{s[0] % (1 << 64):016x}", roots.get(s[0], s[0])) for s in signed], key=repr) == expected


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 300), (201, 200), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}


def test_near_copies_leave_one_row_each(documents):
    kept = simhash.drop_near_copies(documents)
    ids = [r["doc_id"] for r in kept.collect()]
    groups = {r["component_id"] for r in simhash.simhash_groups(documents).collect()}
    assert kept.columns == documents.columns and sorted(ids) == sorted(groups)
