"""Neighbouring rows and time frames of a device without one task per device.

A device's readings are cut into chunks of fixed length and windows run per
(device, chunk). Readings close to a chunk border are copied to the chunks that
look at them, and the few rows whose neighbour lies in another chunk are resolved
in a second pass over chunk borders only. The result equals a window over the
whole device, but a device that holds a large share of all rows spreads over as
many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

BORDER = -1


def chunk_length(reach_s: int, floor_s: int = 600) -> int:
    """Long enough that copied rows stay a fraction of all rows."""
    return max(floor_s, 4 * reach_s)


def spread(rows: DataFrame, chunk_s: int, back_s: int = 0, fwd_s: int = 0) -> DataFrame:
    """Add ``chunk`` and ``own``; rows seen from up to ``back_s`` later or ``fwd_s`` earlier are copied."""
    home = f"floor(epoch / {chunk_s})"
    if not back_s and not fwd_s:
        return rows.selectExpr("*", f"{home} as chunk", "true as own")
    seen_from = f"sequence(floor((epoch - {fwd_s}) / {chunk_s}), floor((epoch + {back_s}) / {chunk_s}))"
    return rows.selectExpr("*", f"explode({seen_from}) as chunk").selectExpr("*", f"chunk = {home} as own")


def framed(number: str, lo_s: int, hi_s: int) -> str:
    """Sum of a whole number over the readings between two offsets (inclusive) from the current second.

    It is the difference of two running sums, each of which passes over the chunk
    once, so its cost does not depend on the length of the frame or the cadence of
    the readings. Whole numbers make the difference exact.
    """
    def until(offset: int) -> str:
        end = "current row" if offset == 0 else f"{abs(offset)} {'preceding' if offset < 0 else 'following'}"
        return (f"coalesce(sum(cast({number} as bigint)) over (partition by fridgeid, chunk order by epoch "
                f"range between unbounded preceding and {end}), 0)")

    return f"({until(hi_s)} - {until(lo_s - 1)})"


def with_neighbours(rows: DataFrame, neighbours: dict[str, tuple[str, int]], keep: str,
                    frames: dict[str, str] | None = None) -> DataFrame:
    """Rows satisfying ``keep``, with the named columns of neighbouring rows attached.

    ``rows`` comes from :func:`spread` and has ``inside`` for rows of the report
    window; only those are neighbours of each other. ``neighbours`` maps a new name
    to (column, offset), negative offsets looking back. ``keep`` is a condition on
    the new names. ``frames`` adds columns made by :func:`framed`. The result has
    ``fridgeid, epoch, reading_id``, the neighbour source columns and the new ones.
    """
    columns = [c for c in dict.fromkeys(c for c, _ in neighbours.values()) if c not in ("epoch", "reading_id")]
    base = ["fridgeid", "epoch", "reading_id", *columns]
    order = ", ".join(["epoch", "reading_id", *columns])
    depth = max(abs(offset) for _, offset in neighbours.values())
    offsets = sorted({offset for _, offset in neighbours.values()} | {-depth, depth})
    frames = frames or {}

    def beside(column: str, offset: int, group: str) -> str:
        function = f"lag({column}, {-offset})" if offset < 0 else f"lead({column}, {offset})"
        return f"{function} over (partition by fridgeid, {group} order by {order})"

    def known(offset: int) -> str:
        return f"coalesce(_chain{'b' if offset < 0 else 'a'}{abs(offset)}, false)"

    def flag(offset: int) -> str:
        return f"_known{'b' if offset < 0 else 'a'}{abs(offset)}"

    # 1. inside each chunk: neighbours, and whether they were in reach
    marked = rows.selectExpr(*["own and inside as own" if c == "own" else c for c in rows.columns])
    marked = marked.selectExpr(
        "*",
        *[f"{beside('own', o, 'chunk')} as _chain{'b' if o < 0 else 'a'}{abs(o)}" for o in offsets],
        *[f"{beside(c, o, 'chunk')} as _{name}" for name, (c, o) in neighbours.items()])
    if frames:
        marked = marked.selectExpr("*", *[f"{sql} as {name}" for name, sql in frames.items()])
    resolved_here = marked.where("own").selectExpr(
        *base, *frames,
        *[f"if({known(o)}, _{name}, null) as {name}" for name, (_, o) in neighbours.items()],
        *[f"{known(o)} as {flag(o)}" for o in offsets],
        f"if({known(-depth)} and {known(depth)}, chunk, {BORDER}) as _group")
    # 2. across chunks: only the rows next to a border look further
    candidates = resolved_here.where(f"_group = {BORDER} or ({keep})")
    resolved = candidates.selectExpr(
        *base, *frames,
        *[f"if({flag(o)}, {name}, {beside(c, o, '_group')}) as {name}" for name, (c, o) in neighbours.items()])
    return resolved.where(keep)
