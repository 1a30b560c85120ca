"""Suffix-array dedup, filter audit and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from coldtrail.llm import conversation_repair as repair
from coldtrail.llm import filter_audit as audit
from coldtrail.llm import queries, suffix_dedup

BLANK = " \t\n\x0b\f\r"


# --- suffix-array dedup ----------------------------------------------------------------------


def kept_by_hand(rows, length):
    """(id, bytes, spans, kept) in corpus order: by id (null last), then the order given."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (text or "").encode()
        covered = bytearray(len(body))
        for s in range(len(body) - length + 1):
            string = body[s:s + length]
            if string in seen:
                covered[s:s + length] = b"\1" * length
            seen.add(string)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(covered))]
        out.append((doc, len(body), spans, bytes(x for x, c in zip(body, covered) if not c)))
    return out


def kept_by_operator(docs, **options):
    rows = suffix_dedup.without_repeats(docs, **options).collect()
    return [(r["doc_id"], r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])) for r in rows]


def texts_with_passages(seed, length):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice("abcdé \n") for _ in range(rnd.randint(length // 2, 4 * length))) for _ in range(10)]
    parts = lambda: rnd.choice([rnd.choice(passages), "".join(rnd.choice("ab ") for _ in range(rnd.randint(0, length))), "a" * rnd.randint(0, 2 * length)])
    texts = ["".join(parts() for _ in range(rnd.randint(0, 7))) for _ in range(40)]
    return list(zip(rnd.sample(range(1000), len(texts)), texts))


@pytest.mark.parametrize("length, block", [(10, 1 << 20), (11, 64), (16, 300), (100, 1 << 20), (100, 256)])
def test_repeats_equal_brute_force(spark, length, block):
    rows = texts_with_passages(length + block, length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got, want = kept_by_operator(docs, length=length, block=block), kept_by_hand(rows, length)
    assert sorted(got) == sorted(want) and sum(len(x[2]) for x in want) > 10


def test_repeats_across_partitions_of_one_hot_string(spark):
    hot = "x" * 3 + "the same passage in every single text, word for word"
    rows = [(i, f"{i:04d} {hot} {i * 7919 % 10007}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert sorted(kept_by_operator(docs, length=20)) == sorted(kept_by_hand(rows, 20))


def test_repeats_in_odd_rows(odd, none, clashing, spark):
    got = kept_by_operator(odd, length=12)
    assert len(got) == odd.count()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(got, key=repr) == sorted(kept_by_hand(rows, 12), key=repr)  # the repeated row 8 loses all of its second copy
    assert suffix_dedup.without_repeats(none).collect() == []
    few = clashing.limit(40).withColumns({c: F.lit("x") for c in ("content", "tie", "start", "starts", "place", "again", "body", "phrases", "marks", "suffix", "edge")})
    plain = few.select("doc_id", "text")
    assert sorted(kept_by_operator(few, length=30)) == sorted(kept_by_operator(plain, length=30))


def test_rows_that_share_an_id_follow_the_order_of_their_hashes(spark):
    texts = ["one long passage that both rows hold, then more", "first words; one long passage that both rows hold", "something quite different from the two others"]
    docs = spark.createDataFrame([(None, t) for t in texts] * 2, "doc_id long, text string")
    order = [r["text"] for r in docs.distinct().orderBy(F.xxhash64(F.col("text").cast("binary"))).collect()]
    want = kept_by_hand([(None, t) for t in order], 20) + [(None, len(t), [(0, len(t))], b"") for t in texts]
    assert sorted(kept_by_operator(docs, length=20), key=repr) == sorted(want, key=repr)


def test_triggers_are_the_same_in_equal_strings():
    rng = np.random.default_rng(0)
    parser, data = suffix_dedup.Parser(30, 100), rng.integers(97, 100, 500).astype(np.uint8)
    twice = np.concatenate([rng.integers(97, 100, 77).astype(np.uint8), data])

    def triggers(body):
        found = {}
        for _, _, _, start, starts, place in parser.phrases(body, np.array([0, len(body)])):
            for a, n, p in zip(start, starts, place):
                found.update({s: a + p for s in range(a, a + n)})
        return found

    one, two = triggers(data), triggers(twice)
    assert sorted(one) == list(range(471)) and sorted(two) == list(range(548))
    assert all(two[s + 77] == t + 77 for s, t in one.items())


def test_repeats_query_equals_brute_force_on_the_given_table(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = [(d, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for d, n, spans, kept in kept_by_hand(rows, 100)]
    got = queries.queries()["op11_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


# --- filter audit ----------------------------------------------------------------------------


def failed_by_hand(rows):
    out = []
    for doc, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any((t or "") == text and d is not None and (doc is None or d < doc) for d, t, _ in rows)
        out.append((doc, source or "", [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), smaller]))
    return out


def audit_by_hand(rows, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    result, failed = {}, failed_by_hand(rows)
    for part in {p for _, p, _ in failed}:
        mine = [(d, f) for d, p, f in failed if p == part]
        shares = [0] * 5
        for order in itertools.permutations(range(5)):
            alive = mine
            for step, k in enumerate(order, 1):
                gone = [(d, f) for d, f in alive if f[k]]
                alive = [(d, f) for d, f in alive if not f[k]]
                shares[k] += len(gone)
                result[part, "".join("ABCDE"[i] for i in order), step] = [
                    k, len(alive), len(gone), sum(f[k] for _, f in mine) - len(gone), sum(f[k] and sum(f) == 1 for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for key, row in result.items():
            if key[0] == part and len(row) == 7:
                result[key] = (*row[1:], shares[row[0]])
    return result


def as_table(frame):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in audit.COUNTS) for r in frame.collect()}


def test_audit_equals_all_orders_applied_one_by_one(spark, documents):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.limit(120).collect()]
    rows += [(10**6, rows[0][1], "extra"), (None, rows[1][1], None), (5, "", ""), (5, None, None)]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert as_table(audit.filter_audit(docs, labels)) == audit_by_hand(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_audit_of_odd_rows(odd, none, clashing, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    got = as_table(audit.filter_audit(odd, labels))
    assert got == audit_by_hand(rows, [(1, 1, 1)])  # of several labels the largest
    assert audit.filter_audit(none, labels).collect() == []
    names = {c: F.lit(1) for c in ("same", "failed", "least", "part", "good", "toxic", "_id", "count")}
    assert as_table(audit.filter_audit(clashing.limit(30).withColumns(names), labels.withColumns({c: x for c, x in names.items() if c != "toxic"}))) == as_table(audit.filter_audit(clashing.limit(30).select("doc_id", "text", "source"), labels))


def test_constrained_least_squares_gives_shapley_values():
    rnd = random.Random(5)
    for n in (2, 3, 5):
        value = [0] + [rnd.randint(0, 1000) for _ in range((1 << n) - 1)]
        want = [Fraction(0)] * n
        orders = list(itertools.permutations(range(n)))
        for order in orders:
            before = 0
            for k in order:
                want[k] += Fraction(value[before | 1 << k] - value[before], len(orders))
                before |= 1 << k
        assert audit.constrained_shares(value) == want


# --- conversation repair ---------------------------------------------------------------------


def cheapest_by_hand(pattern):
    """Dijkstra over (cost, audit): the first to reach the end is the least."""
    rows = [(pattern[i], pattern[i + 1]) for i in range(0, len(pattern), 2)]
    queue, done = [(0, "", 0, 0)], set()
    while queue:
        cost, letters, row, state = heapq.heappop(queue)
        if (row, state) in done:
            continue
        done.add((row, state))
        if row == len(rows) and state in (0, 3):
            return cost, letters
        moves = [("I", 3, row, (2, 2, 3, 2)[state])]
        if row < len(rows):
            initial, fault = rows[row]
            moves.append(("D", 4, row + 1, state))
            if fault not in "bd":
                more = 3 if fault == "t" else 0
                moves.append(("R", 3 + more, row + 1, (2, 2, 3, 2)[state]))
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, initial))
                if to:
                    moves.append(("K", more, row + 1, to))
        for letter, more, r, s in moves:
            heapq.heappush(queue, (cost + more, letters + letter, r, s))
    raise AssertionError


def test_auction_and_trace_equal_dijkstra():
    rnd = random.Random(2)
    patterns = ["".join(rnd.choice("suax") + rnd.choice("bdt...") for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    patterns += ["".join(p) for n in range(3) for p in itertools.product(["s.", "u.", "a.", "ut", "ab", "x."], repeat=n)]
    for pattern in patterns:
        assert repair.solved(pattern) == cheapest_by_hand(pattern), pattern


def test_prices_after_the_auction_undercut_no_arc():
    lattice = repair.Lattice("u.u.atabs.x.utadu.")
    price = repair.auction(lattice)
    assert all(price[node] <= cost + price[ahead] for node in range(lattice.end) for _, cost, ahead in lattice.arcs(node))


def test_a_long_conversation_takes_steps_in_proportion(monkeypatch):
    calls = [0]
    plain = repair.Lattice.arcs

    def counted(self, node):
        calls[0] += 1
        return plain(self, node)

    monkeypatch.setattr(repair.Lattice, "arcs", counted)
    rnd = random.Random(9)
    pattern = "".join(rnd.choice("uuuas") + rnd.choice("bdt...") for _ in range(4000))
    cost, letters = repair.solved(pattern)
    assert calls[0] < 4000 * 12 and sum(c != "I" for c in letters) == 4000
    assert (cost, letters) == cheapest_by_hand(pattern)


def damage_by_hand(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case:
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            kept += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, v in out.items()}


def repaired_by_hand(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(BLANK)
        faults.append("b" if not body else "d" if (role, text) in seen else "." if body[-1] in ".!?" else "t")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    cost, letters = cheapest_by_hand("".join((i if i in ("s", "u", "a") else "x") + f for i, f in zip(initials, faults)))
    said, at, last = [], 0, ""
    for letter in letters:
        if letter != "D":
            last = "assistant" if last[:1] == "u" else "user"
            if letter == "I":
                said.append(f"{last}:")
                continue
            if letter == "K":
                last = rows[at][1]
            said.append(f"{last}:{rows[at][2]}")
        at += 1
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"), illegal, cost, letters, hashlib.sha256("\n".join(said).encode()).hexdigest())


SCHEMA = "conv_id long, turn long, role string, text string"


def by_query(spark, tmp_path, frame):
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    return {r[0]: tuple(r[1:]) for r in queries.queries()["op13_conversation_repair"](spark, str(tmp_path)).collect()}


def test_repair_equals_brute_force_on_odd_conversations(spark, tmp_path):
    rnd = random.Random(4)
    texts = [None, "", " \t", "Done.", "cut off", "Why? ", "Ja!\n", "ünïcode…", "long " * 9000 + "end."]
    rows = [(conv, turn, rnd.choice(["user", "assistant", "system", None, "", "tool", "Umlaut"]), rnd.choice(texts))
            for conv in (*range(60), None) for turn in rnd.sample([None, *range(9)], rnd.randint(1, 8))]
    rows += rows[::7]
    want = {c: repaired_by_hand(v) for c, v in damage_by_hand(rows).items()}
    assert by_query(spark, tmp_path, spark.createDataFrame(rows, SCHEMA).repartition(4)) == want


def test_repair_of_the_given_table_and_of_lost_conversations(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    lost = next(c for c in range(10**6, 10**7) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "gone."))
    got = by_query(spark, tmp_path, spark.createDataFrame(rows, SCHEMA))
    assert got == {c: repaired_by_hand(v) for c, v in damage_by_hand(rows).items()}
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_without_rows_and_with_clashing_columns(spark):
    assert repair.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "So.")], SCHEMA)
    named = rows.withColumns({c: F.lit("x") for c in ("present", "cost", "audit", "gaps", "name")})
    got = repair.repair_conversations(named).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in repair.repair_conversations(rows).collect()]
    assert (got[0]["cost"], got[0]["audit"]) == cheapest_by_hand("u.u.")
