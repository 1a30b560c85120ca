"""Every default threshold by its plain number, and the numbers of the SQL side against those the queries get."""

from __future__ import annotations

from dataclasses import asdict

from coldtrail.limits import Limits
from oracle import settings, values

# The thresholds of the surveyed rules.
DEFAULTS = dict(
    samples_per_day=8640.0, bad_time_min=100, solar_power_w=130.0, mains_power_w=600.0, mains_power_high_w=1000.0,
    mains_power_min_count=2, high_volt=350.0, low_temp_c=2.0, ambient_low_c=10.0, ambient_high_c=40.0,
    overlap_per_hour=370, door_lookback_days=90, code_value_days=7, trip_near_s=30, trip_far_s=60, trip_max_w=1.0,
    stuck_scps=2000, stuck_icps=0, stuck_pv_w=60.0, stuck_day_min=5, stuck_hour_min=5, stuck_hours=4,
    charge_settle_s=120, charge_window_s=120, charge_min_count=8, charge_floor_w=1.0, charge_low_w=160.0,
    charge_high_w=170.0, charge_ambient_c=30.0, volt_min=82.0, volt_max=290.0, legacy_volt_min=90.0, hz_min=45.0,
    hz_max=65.0, hz_ok_pct=95.0, hz_volt_out_pct=3.0, hz_power_ok_pct=15.0, mains_ok_pct=5.0, solar_ok_pct=15.0,
    pv_ok_w=30.0, drain_after_s=86400, drain_minutes=1500, drain_limit=-2.0, battery_volt=0.2, sd_card_min=20,
    data_rx_pct=95.0, dirty_panel_w=120.0, duplicate_per_day=8657.28, door_hours=11, present_pct=90.0,
    holdover_pct=80.0, both_ice_pct=95.0, control_min_rows=5, leak_min_w=10.0, leak_max_w=160.0, leak_pct=95.0,
    zero_pv_w=0.1, zero_pv_rx_pct=5.0, run_w=40.0, run_min_s=300, tech_trip_near_s=30, tech_trip_span_s=60,
    tech_trip_min_count=1, slow_trip_near_s=120, slow_trip_span_s=300, slow_trip_min_count=20)


def test_defaults_are_the_surveyed_thresholds():
    assert asdict(Limits()) == DEFAULTS


def test_both_sides_are_given_the_same_thresholds():
    assert asdict(settings.LIMITS) == vars(values.L)
