"""Fleet tables derived from a generic star schema with an event stream.

Lets every operator run over ``events``, ``orders``, ``customer``, ``nation`` and
``region`` tables: each event becomes a sensor reading or an error record of the
device ``user_id``. The session time zone must be UTC.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .tables import STORED_TIME

# Declared so that building a plan reads no file.
STAR_SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}

# Error codes by event number modulo 20.
ERROR_CODES = (
    "640C", "4408", "440D", "5881", "5882", "5884", "5885", "5888", "5889", "5084",
    "6181", "618B", "E0A1", "4406", "6402", "5404", "6782", "6784", "6301", "630D",
)

# Sensor columns as expressions over one event and the number ``k`` in its properties.
DOUBLES = {
    "EVLN": "if(event_id % 11 = 0, null, value * 4)",
    "EHZLN": "k * 0.3d + 40",
    "EWCP2": "if(event_id % 5 = 0, 0.5d, value * 12)",
    "EWCP": "value * 2",
    "EWDCA": "value",
    "TVCTOPCTL": "if(event_id % 6 = 0, null, value / 10)",
    "TVCBOT": "k / 10d",
    "TAMDAQ": "if(event_id % 9 = 0, null, k * 0.5d - 2)",
    "TICMCTL": "if(event_id % 8 = 0, null, k * 0.1d)",
    "TICBKCTL": "if(event_id % 10 = 0, null, k * 0.2d)",
    "CTBH": "if(event_id % 4 = 1, null, k * 1.5d)",
    "EVDBAT": "k / 100d",
    "ECDBAT": "k / 10d",
    "TEVIN": "value - 20",
    "TCPDISCTL": "value + 20",
}
INTS = {
    "SCPX": "case event_type when 'click' then 1 when 'view' then 0 when 'purchase' then 6 when 'signup' then 2 end",
    "SCPS": "if(event_id % 7 = 0, 2000, 1000)",
    "ICPS": "k % 3",
    "SLNX": "if(event_id % 4 = 0, null, k % 2)",
    "SDXC": "if(event_type = 'signup' and event_id % 3 = 0, 1, 0)",
}
# rounded to the second in whole microseconds
_MICROS = "(unix_micros(cast(ts as timestamp)) + 500000)"
_SECOND = f"timestamp_micros({_MICROS} - pmod({_MICROS}, 1000000))"


class EventFleet:
    """The relations of :class:`~coldtrail.sources.tables.FleetTables`, planned on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def _table(self, name: str) -> DataFrame:
        return self._spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{self._folder}/{name}.parquet")

    @cached_property
    def _events(self) -> DataFrame:
        return self._table("events")

    @cached_property
    def _users(self) -> DataFrame:
        return self._table("events").selectExpr("user_id as fridgeid").distinct()

    @cached_property
    def sensor(self) -> DataFrame:
        # parsed once per event, in a projection of its own
        parsed = self._events.selectExpr("*", "cast(get_json_object(props, '$.k') as int) as k")
        return parsed.selectExpr(
            "user_id as fridgeid", f"{_SECOND} as measureddtm", "event_id as reading_id", f"ts as {STORED_TIME}",
            *[f"cast({e} as double) as {name}" for name, e in DOUBLES.items()],
            *[f"cast({e} as int) as {name}" for name, e in INTS.items()])

    @property
    def solar_sensor(self) -> DataFrame:
        return self.sensor

    @property
    def pv(self) -> DataFrame:
        return self.sensor

    @cached_property
    def errors(self) -> DataFrame:
        codes = ", ".join(f"'{code}'" for code in ERROR_CODES)
        return self._events.where("event_type = 'error'").selectExpr(
            "user_id as fridgeid", f"array({codes})[cast(event_id % 20 as int)] as id",
            f"concat('error ', array({codes})[cast(event_id % 20 as int)]) as description",
            "if(event_id % 20 = 5 and event_id % 3 = 0, '', concat(event_id % 3, '(', cast(floor(value) as int), ')')) as message",
            f"{_SECOND} as measureddtm", f"ts as {STORED_TIME}")

    @cached_property
    def bad_time_errors(self) -> DataFrame:
        return self._events.where("event_type = 'signup'").selectExpr("user_id as fridgeid", f"{_SECOND} as createddtm", f"ts as {STORED_TIME}")

    @cached_property
    def location_history(self) -> DataFrame:
        nation, region = self._table("nation"), self._table("region")
        places = nation.join(region, nation.n_regionkey == region.r_regionkey, "left").selectExpr(
            "cast(n_nationkey as long) as place", "n_name as country", "r_name as L1")
        placed = self._table("orders").selectExpr(
            "o_custkey as fridgeid", "cast(o_orderdate as timestamp) as createddtm", "o_orderkey as location_id",
            "o_orderkey % 25 as place", "o_orderpriority as L3", "cast(o_orderdate as date) as commDte",
            "if(o_orderstatus = 'F', 1, 0) as report")
        rows = placed.join(self._users, "fridgeid", "left_semi").join(places, "place", "left")
        return rows.select("fridgeid", "createddtm", "location_id", "country", "L1", "L3", "commDte", "report")

    @cached_property
    def device(self) -> DataFrame:
        names = self._table("customer").selectExpr("c_custkey as fridgeid", "c_name as FridgeShortSN")
        return names.join(self._users, "fridgeid", "left_semi")

    @cached_property
    def device_group(self) -> DataFrame:
        return self._users.selectExpr(
            "fridgeid", "explode(array_compact(array(if(fridgeid % 3 = 0, 'solar', null), "
                        "if(fridgeid % 17 = 0, 'freezer', null)))) as GroupName")


def fleet_from_events(spark: SparkSession, folder: str) -> EventFleet:
    return EventFleet(spark, folder)
