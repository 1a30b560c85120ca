"""Texts, addresses and numbers of the SQL side, written out: nothing here is taken from the code under test."""

from __future__ import annotations

from types import SimpleNamespace

# Message texts and codes of the engineering report.
AMBIENT_HIGH = ("TAMDAQ High Temp Alerts", "measuredDtm of the max TAMDAQ above 40C")
AMBIENT_LOW = ("TAMDAQ Low Temp Alerts", "measuredDtm of the min TAMDAQ below 10C")
BAD_TIME = ("Bad Time ", "Help Field Techs Troubleshoot Bad Time and Using Incorrect FridgeID")
CHARGE = "Low compressor power, check for low charge"
CHARGE_HIGH = "2 minute average < 170 watts, high ambient"
CHARGE_LOW = "2 minute average < 160 watts, low ambient"
CHARGE_LOW_EVENT = "2 minute average < 160 watts , low ambient"
CODE_PARAMETER = "&var-ERRORS="
DAQ_CODES = ("640C", "4408", "440D", "5881", "5882", "5884", "5885", "5888", "5889", "5084")
DAQ_ERROR = "DAQ Error : "
FAILED_START = ("too many failed starts", "measuredDtm of the first PCOMP signal's failed start attempt")
LOW_BOTTOM = "excursion is TVCBOT < 2"
LOW_TEMP = "Low Temperature Alert"
LOW_TOP = "excursion is TVCTOPCTL < 2"
MAINS_DAY_1000 = "EWCP > 1000 threshold condition was met(with 1 or more such records)."
MAINS_DAY_600 = "EWCP > 600 threshold was met( 2 or more such records exists)"
MAINS_EVENT_1000 = "EWCP > 1000 threshold condtions met"
MAINS_EVENT_600 = "EWCP > 600 threshold was met"
MAINS_POWER = "high compressor power (Main Fridge)"
NO_DOOR = ("Door Openings", "No door openings over the week")
OVERLAP = ("Overlapping data/FridgeID", "More than 370 measurements in this hour")
SENSOR_ERROR = "DAQ sensor error"
SOLAR_POWER = ("high compressor power (Solar Fridge)", "EWCP > 130 threshold was met")
SOLAR_STUCK = "solar compressor not running"
TRIP = "Mech Thermostat Engaged"
TRIP_START = "Event Time of thermostat trips before compressor is supposed to start but doesn't"
TRIP_STOP = "Event Time of thermostat trips when compressor is running"
VOLTAGE = "High voltage event"
VOLTAGE_DAY = "EventTime of the first high voltage event "
VOLTAGE_EVENT = "measuredDtm of the first high voltage event"

# Chart addresses.
BASE = SimpleNamespace(
    device_mains="https://charts.example.org/device/mains?fridgeid=", device_solar="https://charts.example.org/device/solar?fridgeid=",
    errors_mains="https://charts.example.org/errors/mains?fid=", errors_solar="https://charts.example.org/errors/solar?fid=")
TECH_SLACK = 28800

# Thresholds for the generic test tables, as the queries get them from the settings.
L = SimpleNamespace(
    samples_per_day=2.0, bad_time_min=1, solar_power_w=130.0, mains_power_w=600.0, mains_power_high_w=1000.0,
    mains_power_min_count=2, high_volt=350.0, low_temp_c=2.0, ambient_low_c=10.0, ambient_high_c=40.0,
    overlap_per_hour=2, door_lookback_days=90, code_value_days=7, trip_near_s=3600, trip_far_s=21600,
    trip_max_w=300.0, stuck_scps=2000, stuck_icps=0, stuck_pv_w=60.0, stuck_day_min=0, stuck_hour_min=0,
    stuck_hours=1, charge_settle_s=3600, charge_window_s=21600, charge_min_count=0, charge_floor_w=1.0,
    charge_low_w=300.0, charge_high_w=600.0, charge_ambient_c=30.0, volt_min=82.0, volt_max=290.0,
    legacy_volt_min=90.0, hz_min=45.0, hz_max=65.0, hz_ok_pct=70.0, hz_volt_out_pct=3.0, hz_power_ok_pct=60.0,
    mains_ok_pct=55.0, solar_ok_pct=75.0, pv_ok_w=30.0, drain_after_s=86400, drain_minutes=1500, drain_limit=-2.0,
    battery_volt=0.2, sd_card_min=20, data_rx_pct=95.0, dirty_panel_w=180.0, duplicate_per_day=5.0, door_hours=2,
    present_pct=92.0, holdover_pct=80.0, both_ice_pct=95.0, control_min_rows=5, leak_min_w=10.0, leak_max_w=160.0,
    leak_pct=95.0, zero_pv_w=150.0, zero_pv_rx_pct=0.5, run_w=40.0, run_min_s=300, tech_trip_near_s=3600,
    tech_trip_span_s=18000, tech_trip_min_count=0, slow_trip_near_s=7200, slow_trip_span_s=18000,
    slow_trip_min_count=0)
