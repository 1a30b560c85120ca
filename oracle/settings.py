"""Windows and thresholds for the generic test tables, shared by the queries and their SQL.

Readings there are hours apart, so frames and counts are wider than the defaults.
The windows span the whole event stream except where a rule is about one week.
"""

from __future__ import annotations

from dataclasses import replace

from coldtrail.limits import Limits

START, END = "2024-01-01", "2024-01-31"
WEEK_START, WEEK_END = "2024-01-21", "2024-01-28"
LAST_DAY = "2024-01-30"
# two engineering runs a week apart (their windows overlap by a day) and one technician run
RUN_BEFORE, RUN_TIME = "2024-01-20 06:30:00", "2024-01-27 06:30:00"
TECH_RUN_TIME = "2024-01-29 06:30:00"
EXCLUDED = "NATION_0"
COUNTRY = "NATION_7"

LIMITS = replace(
    Limits(),
    samples_per_day=2.0, bad_time_min=1, overlap_per_hour=2, duplicate_per_day=5.0,
    trip_near_s=3600, trip_far_s=21600, trip_max_w=300.0,
    charge_settle_s=3600, charge_window_s=21600, charge_min_count=0, charge_low_w=300.0, charge_high_w=600.0,
    stuck_day_min=0, stuck_hour_min=0, stuck_hours=1,
    tech_trip_near_s=3600, tech_trip_span_s=18000, tech_trip_min_count=0,
    slow_trip_near_s=7200, slow_trip_span_s=18000, slow_trip_min_count=0,
    mains_ok_pct=55.0, solar_ok_pct=75.0, dirty_panel_w=180.0, zero_pv_w=150.0, zero_pv_rx_pct=0.5,
    hz_ok_pct=70.0, hz_power_ok_pct=60.0, present_pct=92.0, door_hours=2,
)
