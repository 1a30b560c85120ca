"""Every threshold of the detectors in one immutable object.

The defaults are the values for devices that report every 10 seconds; tables
with another cadence pass ``dataclasses.replace(Limits(), ...)``.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    # expected cadence: 8,640 readings a day, 6 a minute
    samples_per_day: float = 8640.0

    # engineering report
    bad_time_min: int = 100
    solar_power_w: float = 130.0
    mains_power_w: float = 600.0
    mains_power_high_w: float = 1000.0
    mains_power_min_count: int = 2
    high_volt: float = 350.0
    low_temp_c: float = 2.0
    ambient_low_c: float = 10.0
    ambient_high_c: float = 40.0
    overlap_per_hour: int = 370
    door_lookback_days: int = 90
    code_value_days: int = 7

    # thermostat events of the engineering report, around the last reading before the edge
    trip_near_s: int = 30
    trip_far_s: int = 60
    trip_max_w: float = 1.0
    stuck_scps: int = 2000
    stuck_icps: int = 0
    stuck_pv_w: float = 60.0
    stuck_day_min: int = 5
    stuck_hour_min: int = 5
    stuck_hours: int = 4

    # low compressor power just before shutdown
    charge_settle_s: int = 120
    charge_window_s: int = 120
    charge_min_count: int = 8
    charge_floor_w: float = 1.0
    charge_low_w: float = 160.0
    charge_high_w: float = 170.0
    charge_ambient_c: float = 30.0

    # technician report
    volt_min: float = 82.0
    volt_max: float = 290.0
    legacy_volt_min: float = 90.0
    hz_min: float = 45.0
    hz_max: float = 65.0
    hz_ok_pct: float = 95.0
    hz_volt_out_pct: float = 3.0
    hz_power_ok_pct: float = 15.0
    mains_ok_pct: float = 5.0
    solar_ok_pct: float = 15.0
    pv_ok_w: float = 30.0
    drain_after_s: int = 86400
    drain_minutes: int = 1500
    drain_limit: float = -2.0
    battery_volt: float = 0.2
    sd_card_min: int = 20
    data_rx_pct: float = 95.0
    dirty_panel_w: float = 120.0
    duplicate_per_day: float = 8640.0 * 1.002
    door_hours: int = 11
    present_pct: float = 90.0
    holdover_pct: float = 80.0
    both_ice_pct: float = 95.0
    control_min_rows: int = 5
    leak_min_w: float = 10.0
    leak_max_w: float = 160.0
    leak_pct: float = 95.0
    zero_pv_w: float = 0.1
    zero_pv_rx_pct: float = 5.0
    run_w: float = 40.0
    run_min_s: int = 300

    # thermostat count of the technician report, around the first reading after the edge
    tech_trip_near_s: int = 30
    tech_trip_span_s: int = 60
    tech_trip_min_count: int = 1
    slow_trip_near_s: int = 120
    slow_trip_span_s: int = 300
    slow_trip_min_count: int = 20
