"""Compressor state changes and the power drawn around them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..limits import Limits
from ..sources.tables import keyed_readings
from .timeline import chunk_length, framed, spread, with_neighbours


@dataclass(frozen=True)
class EdgeFrame:
    """Running samples between ``lo_s`` and ``hi_s`` from the edge.

    The edge is a ``stop`` (1 to another state) or a ``start``; its time is that of
    the last reading ``before`` or the first reading ``after`` the change, moved by
    ``shift_s``.
    """

    name: str
    change: str
    anchor: str
    lo_s: int
    hi_s: int
    shift_s: int = 0


def trip_frames(limits: Limits) -> list[EdgeFrame]:
    """Inclusive frames around the reading before the edge."""
    near, far = limits.trip_near_s, limits.trip_far_s
    return [EdgeFrame("stop_trip", "stop", "before", -far, -near),
            EdgeFrame("start_trip", "start", "before", near, far)]


def charge_frame(limits: Limits) -> EdgeFrame:
    """Exclusive frame ending a settling time before the reading after the edge."""
    settle, span = limits.charge_settle_s, limits.charge_window_s
    return EdgeFrame("charge", "stop", "after", 1 - settle - span, -settle - 1, -settle)


def tech_stop_frame(near_s: int, span_s: int) -> EdgeFrame:
    return EdgeFrame("tech_stop", "stop", "after", 1 - near_s - span_s, -near_s - 1, -near_s)


def tech_start_frame(near_s: int, span_s: int) -> EdgeFrame:
    return EdgeFrame("tech_start", "start", "after", near_s + 1, near_s + span_s - 1, near_s)


SCALE = 1_000_000  # power and temperature are summed in millionths


def _scaled(column: str) -> str:
    return f"cast(round({column} * {SCALE}) as bigint)"


def _mean(total: str, count: str) -> str:
    return f"try_divide(cast({total} as double) / {SCALE}, {count})"


def edge_power(sensor: DataFrame, start, end, frames: list[EdgeFrame]) -> DataFrame:
    """One row per device, frame and edge time that has running samples.

    Columns: ``fridgeid, name, EventTime, samples, avg_w, avg_ambient``. Samples may
    lie outside the window, edges may not. Edges of the same second are one row
    whose samples count once per edge.
    """
    back = max(0, *[-f.lo_s for f in frames])
    fwd = max(0, *[f.hi_s for f in frames])
    rows = keyed_readings(sensor, start, end, "SCPX", "EWCP2", "TAMDAQ", back_s=back, fwd_s=fwd)
    rows = spread(rows, chunk_length(max(back, fwd)), back_s=back, fwd_s=fwd)

    offset = {"before": ("next_state", 1), "after": ("prev_state", -1)}
    neighbours = {offset[f.anchor][0]: ("SCPX", offset[f.anchor][1]) for f in frames}
    sampled = "SCPX = 1 and EWCP2 != 0"
    sums = {}
    for f in frames:
        parts = {
            "samples": f"if({sampled}, 1, 0)", "w_sum": f"if({sampled}, {_scaled('EWCP2')}, 0)",
            "ambient_n": f"if({sampled} and TAMDAQ is not null, 1, 0)", "ambient_sum": f"if({sampled}, coalesce({_scaled('TAMDAQ')}, 0), 0)"}
        sums |= {f"{f.name}_{part}": framed(number, f.lo_s, f.hi_s) for part, number in parts.items()}
    is_edge = {f.name: _CHANGES[f.change, f.anchor] for f in frames}
    edges = with_neighbours(rows, neighbours, " or ".join(f"({c})" for c in is_edge.values()), sums)
    listed = ", ".join(
        f"struct('{f.name}' as name, coalesce({is_edge[f.name]}, false) as is_edge, epoch + {f.shift_s} as at, "
        f"{f.name}_samples as samples, {_mean(f'{f.name}_w_sum', f'{f.name}_samples')} as avg_w, "
        f"{_mean(f'{f.name}_ambient_sum', f'{f.name}_ambient_n')} as avg_ambient)" for f in frames)
    return (
        edges.selectExpr("fridgeid", f"inline(array({listed}))")
        .where("is_edge and samples > 0")
        .groupBy("fridgeid", "name", "at")
        .agg(F.expr("max(samples) * count(1) as samples"), F.expr("max(avg_w) as avg_w"), F.expr("max(avg_ambient) as avg_ambient"))
        .selectExpr("fridgeid", "name", "timestamp_seconds(at) as EventTime", "samples", "avg_w", "avg_ambient")
    )


# state change as a condition on a reading and its neighbour
_CHANGES = {
    ("stop", "before"): "SCPX = 1 and next_state != 1",
    ("start", "before"): "SCPX != 1 and next_state = 1",
    ("stop", "after"): "prev_state = 1 and SCPX != 1",
    ("start", "after"): "prev_state != 1 and SCPX = 1",
}
