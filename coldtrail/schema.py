"""Declared schemas of the source and report tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of the sources and reports.
_MEASURES = (
    "EVLN", "EHZLN", "EWCP2", "EWCP", "EWDCA", "TVCTOPCTL", "TVCBOT", "TAMDAQ", "TICMCTL",
    "TICBKCTL", "CTBH", "EVDBAT", "ECDBAT", "TEVIN", "TCPDISCTL",
)
_STATES = ("SCPX", "SCPS", "ICPS", "SLNX", "SDXC")


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


L, I, D, S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
TS, DATE = T.TimestampType(), T.DateType()

# reading_id and location_id only break ties between rows of one device and second
SENSOR = _struct(
    ("fridgeid", L), ("measureddtm", TS), ("reading_id", L),
    *[(c, D) for c in _MEASURES], *[(c, I) for c in _STATES],
)
ERRORS = _struct(("fridgeid", L), ("id", S), ("description", S), ("message", S), ("measureddtm", TS))
BAD_TIME_ERRORS = _struct(("fridgeid", L), ("createddtm", TS))
LOCATION_HISTORY = _struct(
    ("fridgeid", L), ("createddtm", TS), ("location_id", L), ("country", S), ("L1", S), ("L3", S),
    ("commDte", DATE), ("report", I),
)
DEVICE = _struct(("fridgeid", L), ("FridgeShortSN", S))
DEVICE_GROUP = _struct(("fridgeid", L), ("GroupName", S))

REPORT_ENG = _struct(
    ("CreatedDtm", TS), ("Country", S), ("L1", S), ("L3", S), ("StartDate", DATE), ("EndDate", DATE),
    ("ReportDays", I), ("FridgeId", L), ("FridgeShortSN", S), ("FridgeType", S), ("Message", S),
    ("Detail", S), ("value", S), ("EventTime", TS), ("RecCount", I), ("Link", S),
    ("MessageInterval", S), ("GLink", S),
)
REPORT_TECH = _struct(
    ("Priority", S), ("Country", S), ("L1", S), ("L3", S), ("StartDate", DATE), ("EndDate", DATE),
    ("ReportDays", I), ("FridgeId", L), ("FridgeShortSN", S), ("FridgeType", S), ("Deployed", S),
    ("commDte", DATE), ("Message", S), ("Detail", S), ("value", D),
    ("TVCTOPCTLavg", T.DecimalType(8, 1)), ("CTBH", T.DecimalType(6, 1)),
    ("SLNX", T.DecimalType(6, 1)), ("DataRx", T.DecimalType(6, 1)), ("CompRunAgeMin", I),
    ("CompRunAge", S), ("DataAge", S), ("Link", S),
)
SIM_BILLING = T.StructType([
    T.StructField(name, kind, nullable) for name, kind, nullable in (
        ("SUBSCRIBER_ID", S, True), ("DEVICE_ID", L, True), ("IMSI", L, True), ("ICCID", S, False),
        ("MSISDN", L, True), ("BILL_PERIOD", I, False), ("BILL_PERIOD_YR", I, False),
        ("BILL_PERIOD_MO", I, False), ("BILL_STATUS", S, True), ("BILL_STATUS_START", DATE, True),
        ("BILL_STATUS_END", DATE, True), ("HOME_ZONE", S, True), ("ZONE_NAME", S, True),
        ("RATE_PLAN_START", DATE, True), ("RATE_PLAN_END", DATE, True),
        ("ACTIVE_DAYS_IN_PLAN", I, True), ("PRORATE_FACTOR", D, True), ("BILL_PKT_KB", I, True),
        ("BILL_PKT_PRICE", D, True), ("BILL_TOTAL_TRAFFIC_CHARGES", D, True),
    )
])
