"""Chunked operators against brute force over whole devices, with ties, gaps and a heavy device."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest

from coldtrail.limits import Limits
from coldtrail.operators import edges, timeline
from coldtrail.operators.asof import next_day_pairs
from coldtrail.operators.runs import last_compressor_run
from fixtures import T0, WEEK, at, make_fleet, reading


def series(seed: int, count: int, step: int = 10, gaps: bool = True):
    """Readings of device 1 (most of them) and 2, some in the same second, some around the window."""
    rng = random.Random(seed)
    rows, now = [], -300
    for _ in range(count):
        now += rng.choice([0, step, step, step, step, 3 * step])
        if gaps and rng.random() < 0.01:
            now += rng.randrange(600, 5000)
        rows.append(reading(1 if rng.random() < 0.8 else 2, at(now), SCPX=rng.choice([0, 1, 1, 1, 6, None]),
                            EWCP2=rng.choice([0.0, 0.5, 30.0, 155.0, 200.0, None]), TAMDAQ=rng.choice([20.0, 35.0, None]),
                            ECDBAT=rng.choice([5.0, 7.5, 9.0, None])))
    return rows


def ordered(rows, device, start, end):
    mine = [{"reading_id": i, **r} for i, r in enumerate(rows) if r["fridgeid"] == device]
    return sorted((r for r in mine if start <= r["measureddtm"] < end), key=lambda r: (r["measureddtm"], r["reading_id"]))


def brute_edges(rows, frame, start, end):
    found = {}
    for device in (1, 2):
        inside = ordered(rows, device, start, end)
        for a, b in zip(inside, inside[1:]):
            s1, s2 = a["SCPX"], b["SCPX"]
            if s1 is None or s2 is None:
                continue
            if not ((s1 == 1 and s2 != 1) if frame.change == "stop" else (s1 != 1 and s2 == 1)):
                continue
            edge = (a if frame.anchor == "before" else b)["measureddtm"]
            near = [r for r in rows if r["fridgeid"] == device and r["SCPX"] == 1 and r["EWCP2"]
                    and frame.lo_s <= (r["measureddtm"] - edge).total_seconds() <= frame.hi_s]
            if near:
                key = (device, int((edge - T0).total_seconds()) + frame.shift_s)
                ct, _, _ = found.get(key, (0, 0, 0))
                warm = [r["TAMDAQ"] for r in near if r["TAMDAQ"] is not None]
                found[key] = (ct + len(near), round(sum(r["EWCP2"] for r in near) / len(near), 6),
                              round(sum(warm) / len(warm), 6) if warm else None)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_edge_power_equals_theta_join(spark, seed, monkeypatch):
    rows = series(seed, 900)
    limits = Limits()
    frames = [*edges.trip_frames(limits), edges.charge_frame(limits), edges.tech_stop_frame(30, 60), edges.tech_start_frame(30, 60)]
    fleet = make_fleet(spark, sensor=rows)
    start, end = at(0), at(6000)
    # chunks shorter than the frames: several copies of each reading
    monkeypatch.setattr(edges, "chunk_length", lambda reach: 90)
    got = edges.edge_power(fleet.sensor, start, end, frames).collect()
    for frame in frames:
        mine = {(r.fridgeid, int((r.EventTime - T0).total_seconds())): (r.samples, round(r.avg_w, 6), None if r.avg_ambient is None else round(r.avg_ambient, 6))
                for r in got if r.name == frame.name}
        assert mine == brute_edges(rows, frame, start, end), frame.name


def test_neighbours_cross_chunk_borders(spark):
    rows = series(3, 600)
    start, end = at(0), at(5000)
    fleet = make_fleet(spark, sensor=rows)
    from coldtrail.sources.tables import keyed_readings

    keyed = timeline.spread(keyed_readings(fleet.sensor, start, end, "EWCP2"), 60)
    got = timeline.with_neighbours(
        keyed, {"p1": ("epoch", -1), "n1": ("epoch", 1), "n2": ("reading_id", 2)}, "true").collect()
    want = set()
    for device in (1, 2):
        inside = ordered(rows, device, start, end)
        for i, r in enumerate(inside):
            def take(j, key):
                return inside[j][key] if 0 <= j < len(inside) else None
            want.add((device, r["reading_id"], take(i - 1, "measureddtm"), take(i + 1, "measureddtm"), take(i + 2, "reading_id")))
    epoch0 = 1704585600

    def when(second):
        return None if second is None else at(second - epoch0)

    assert {(r.fridgeid, r.reading_id, when(r.p1), when(r.n1), r.n2) for r in got} == want
    assert len(got) == len(want)


@pytest.mark.parametrize("seed", [5, 6])
def test_next_day_pairs_equal_join(spark, seed):
    rng = random.Random(seed)
    rows = [reading(1, at(rng.randrange(0, 5 * 86400)), ECDBAT=rng.choice([3.0, 5.5, 9.0, None])) for _ in range(400)]
    got = {(r.startDtm, r.endDtm, r.battDiff) for r in next_day_pairs(make_fleet(spark, sensor=rows).sensor, *WEEK, chunk_s=1200).collect()}
    inside = ordered(rows, 1, *WEEK)
    want = set()
    for r in inside:
        later = [x for x in inside if (x["measureddtm"] - r["measureddtm"]).total_seconds() >= 86400]
        if not later or r["ECDBAT"] is None or later[0]["ECDBAT"] is None:
            continue
        first = later[0]
        minutes = first["measureddtm"].timestamp() // 60 - r["measureddtm"].timestamp() // 60
        if minutes < 1500:
            want.add((r["measureddtm"], first["measureddtm"], first["ECDBAT"] - r["ECDBAT"]))
    assert got == want and want


def brute_run(inside, start, limit_w, limit_s):
    power = [r["EWCP2"] if r["EWCP2"] is not None else (inside[i + 1]["EWCP2"] if i + 1 < len(inside) else None)
             for i, r in enumerate(inside)]
    on = [(p or 0) > limit_w for p in power]
    changes = []
    for i, r in enumerate(inside):
        st = on[i] and i > 0 and not on[i - 1]
        sp = on[i] and i + 1 < len(inside) and not on[i + 1]
        if st != sp:
            changes.append((r["measureddtm"], sp))
    if inside and inside[-1]["measureddtm"] > start and (inside[-1]["EWCP2"] or 0) > limit_w:
        changes.append((inside[-1]["measureddtm"], True))
    changes.sort()
    runs = [(b[0], int((b[0] - a[0]).total_seconds())) for a, b in zip(changes, changes[1:]) if b[1]]
    long = [r for r in runs if r[1] > limit_s]
    return max(long) if long else None


@pytest.mark.parametrize("seed", range(4))
def test_last_compressor_run_equals_brute_force(spark, seed, monkeypatch):
    from coldtrail.operators import runs

    monkeypatch.setattr(runs, "CHUNK_S", 70)
    rng = random.Random(seed)
    rows, now, on = [], 0, False
    for _ in range(500):
        now += rng.choice([10, 10, 10, 40])
        on = on if rng.random() < 0.9 else not on
        rows.append(reading(rng.choice([1, 1, 2]), at(now), EWCP2=rng.choice([120.0, 120.0, None]) if on else rng.choice([0.0, 40.0, None])))
    limits = replace(Limits(), run_min_s=60)
    start, end = at(0), at(now - 200)
    got = {r.fridgeid: (r.lastDte, r.runDurSec) for r in last_compressor_run(make_fleet(spark, sensor=rows).sensor, start, end, limits).collect()}
    want = {d: brute_run(ordered(rows, d, start, end), start, 40, 60) for d in (1, 2)}
    assert got == {d: w for d, w in want.items() if w}


def test_compressor_running_when_data_ends(spark):
    rows = [reading(1, at(10 * i), EWCP2=0 if i < 3 else 100) for i in range(60)]
    row = last_compressor_run(make_fleet(spark, sensor=rows).sensor, *WEEK).first()
    assert (row.lastDte, row.runDurSec) == (at(590), 560)
    assert row.runAgeMin == 7 * 1440 - 9
