"""Last long compressor run of each device."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timebucket import epoch_of
from ..limits import Limits
from ..sources.tables import keyed_readings
from .timeline import spread, with_neighbours

CHUNK_S = 1800


def last_compressor_run(sensor: DataFrame, start, end, limits: Limits = Limits()) -> DataFrame:
    """``fridgeid, lastDte, runDurSec, runAgeMin`` of the last run longer than ``run_min_s``.

    A missing sample takes the next one's power. A change is a reading above
    ``run_w`` next to one at or below it; pulses of a single reading are not
    changes. A compressor still running at the last reading stops there.
    """
    rows = spread(keyed_readings(sensor, start, end, "EWCP2"), CHUNK_S)
    level = limits.run_w

    def on(*power: str) -> str:
        return f"coalesce({', '.join(power)}, 0) > {level}"

    running = on("EWCP2", "next1_w")
    begins = f"coalesce({running} and prev_at is not null and not {on('prev_w', 'EWCP2')}, false)"
    stops = f"coalesce({running} and next_at is not null and not {on('next1_w', 'next2_w')}, false)"
    change = f"({begins}) != ({stops})"
    cut_off = f"next_at is null and EWCP2 > {level} and epoch > {epoch_of(start)}"
    edges = with_neighbours(
        rows,
        {"prev_at": ("epoch", -1), "prev_w": ("EWCP2", -1), "next_at": ("epoch", 1),
         "next1_w": ("EWCP2", 1), "next2_w": ("EWCP2", 2)},
        f"({change}) or ({cut_off})")
    # a start and the stop at the last reading may share a second: starts come first
    changes = edges.selectExpr(
        "fridgeid", "epoch", f"explode(filter(array(if({change}, {stops}, null), if({cut_off}, true, null)), c -> c is not null)) as is_stop"
    ).selectExpr("fridgeid", "epoch", "cast(is_stop as long) as reading_id", "true as inside")
    runs = with_neighbours(
        spread(changes, CHUNK_S), {"since": ("epoch", -1)}, f"reading_id = 1 and epoch - since > {limits.run_min_s}")
    last = runs.groupBy("fridgeid").agg(F.expr("max(struct(epoch, epoch - since as sec)) as run"))
    minute = epoch_of(end) // 60
    return last.selectExpr(
        "fridgeid", "timestamp_seconds(run.epoch) as lastDte", "cast(run.sec as int) as runDurSec",
        f"cast({minute} - floor(run.epoch / 60) as int) as runAgeMin")
