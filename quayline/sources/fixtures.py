"""The test tables as raw shipments, events and ports: text columns with the defects that the rules look for.

The SQL is understood by Spark and by the oracle alike. A line item is a shipment, a nation a port, an event an
event; the fourth region's nations are no known ports. _row_number is made of the row's own values. Some rows come
twice, with a number further on. The damaged tables break rules of the contract that curation itself never breaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domain as D
from ..operators.curation import Curated, Raw

PORTS_SQL = """
SELECT concat('P', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS port_code, n_name AS port_name,
  CASE n_nationkey WHEN 7 THEN '' ELSE n_name END AS country, r_name AS region, concat('UTC+', CAST(n_nationkey % 12 AS STRING)) AS timezone,
  CAST(n_nationkey / CAST(25 AS DOUBLE) AS STRING) AS avg_congestion_score, CAST(n_nationkey AS BIGINT) AS _row_number
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey < 4
"""

_SHIPMENTS_ONCE = """
SELECT concat('SHP-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS shipment_id,
  concat('CUST-', CAST(c_custkey AS STRING)) AS customer_id,
  concat('P', lpad(CAST(s_nationkey AS STRING), 2, '0')) AS origin_port, concat('p', lpad(CAST(c_nationkey AS STRING), 2, '0'), ' ') AS destination_port,
  concat('VSL-', lpad(CAST(l_suppkey % 100 AS STRING), 4, '0')) AS vessel_id,
  CAST(o_orderdate AS STRING) AS booking_date,
  CASE WHEN l_partkey % 41 = 0 THEN 'soon' WHEN l_partkey % 43 = 0 THEN CAST(o_orderdate - INTERVAL 3 DAY AS STRING) ELSE CAST(o_orderdate + INTERVAL 7 DAY AS STRING) END AS planned_departure,
  CASE WHEN l_partkey % 11 = 0 THEN CAST(o_orderdate - INTERVAL 1 DAY AS STRING) WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate + INTERVAL 8 DAY AS STRING) END AS actual_departure,
  CAST(o_orderdate + INTERVAL 30 DAY AS STRING) AS planned_arrival,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN l_quantity <= 10 THEN CAST(o_orderdate + INTERVAL 29 DAY AS STRING) WHEN l_quantity <= 30 THEN CAST(o_orderdate + INTERVAL 31 DAY AS STRING)
    WHEN l_quantity <= 31 THEN CAST(o_orderdate + INTERVAL 2 DAY AS STRING) ELSE CAST(o_orderdate + INTERVAL 33 DAY AS STRING) END AS actual_arrival,
  CAST(CAST(l_quantity AS INT) * 3 - 3 AS STRING) AS container_count,
  CASE p_size % 12 WHEN 0 THEN 'Apparel' WHEN 1 THEN 'automotive  parts' WHEN 2 THEN 'Chemicals' WHEN 3 THEN ' CONSUMER goods' WHEN 4 THEN 'Electronics' WHEN 5 THEN 'Food & Beverage'
    WHEN 6 THEN 'Furniture' WHEN 7 THEN 'Machinery' WHEN 8 THEN 'Pharmaceuticals' WHEN 9 THEN 'Raw Materials' WHEN 10 THEN NULL ELSE 'Spice' END AS cargo_type,
  CASE WHEN l_partkey % 17 = 0 THEN '-5' WHEN l_partkey % 19 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS weight_tons,
  CASE WHEN o_orderstatus = 'P' THEN 'canceled' WHEN l_linenumber = 1 THEN 'Complete' WHEN l_linenumber = 2 THEN 'DELAYED' WHEN l_linenumber = 3 THEN 'N/A' ELSE 'DELIVERED' END AS status,
  l_partkey * 1000000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT) AS _row_number
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
"""

#: The same joins in the order in which Spark runs them: customers meet orders, not each order's items.
_JOINED = _SHIPMENTS_ONCE[_SHIPMENTS_ONCE.index("FROM lineitem") :]
_JOINED_FOR_SPARK = "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) booked ON l_orderkey = o_orderkey\n"

_EVENTS_ONCE = """
SELECT concat('EVT-', CAST(event_id % 9000 AS STRING)) AS event_id,
  CASE WHEN event_id % 97 = 0 THEN 'later' ELSE substr(CAST(ts AS STRING), 1, 19) END AS event_timestamp,
  concat('P', lpad(CAST(user_id % 25 AS STRING), 2, '0')) AS port_code,
  CASE WHEN user_id % 50 = 1 THEN 'VSL-9999' ELSE concat('VSL-', lpad(CAST(user_id % 100 AS STRING), 4, '0')) END AS vessel_id,
  CASE event_type WHEN 'error' THEN 'delayed' WHEN 'click' THEN 'ARRIVAL' WHEN 'view' THEN 'DEPARTURE' WHEN 'purchase' THEN 'INSPECTION' WHEN 'signup' THEN '' ELSE 'LOST' END AS event_type,
  CASE WHEN event_id % 31 = 0 THEN '0' WHEN event_id % 37 = 0 THEN '2000' ELSE CAST(event_id % 300 AS STRING) END AS delay_minutes,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'Normal operations' ELSE 'Crane' END AS notes,
  event_id AS _row_number
FROM events
"""


def _some_twice(sql: str, columns: tuple[str, ...], every: int) -> str:
    """The rows of a query, and again those whose number is a multiple of every, with a number further on."""
    return f"SELECT {', '.join(columns)}, _row_number + again AS _row_number FROM ({sql}) a CROSS JOIN (SELECT CAST(0 AS BIGINT) AS again UNION ALL SELECT 900000000000000000 AS again) b WHERE again = 0 OR _row_number % {every} = 0"


SHIPMENTS_SQL = _some_twice(_SHIPMENTS_ONCE, D.SHIPMENT_COLUMNS, 23)
EVENTS_SQL = _some_twice(_EVENTS_ONCE, D.EVENT_COLUMNS, 19)

#: Damage to curated tables: new values by column, rows that are lost, rows that come twice. Both engines read these expressions.
DAMAGED_SHIPMENTS = (
    {
        "shipment_id": "CASE WHEN _source_row % 89 = 0 THEN NULL WHEN _source_row % 83 = 0 THEN 'SHP-1' ELSE shipment_id END",
        "origin_port": "CASE WHEN _source_row % 79 = 0 THEN 'XX' ELSE origin_port END",
        "booking_date": "CASE WHEN _source_row % 73 = 0 THEN NULL ELSE booking_date END",
        "status": "CASE WHEN _source_row % 71 = 0 THEN 'LOST' WHEN _source_row % 67 = 0 THEN 'DELIVERED' ELSE status END",
        "cargo_type": "CASE WHEN _source_row % 61 = 0 THEN 'Spice' ELSE cargo_type END",
        "container_count": "CASE WHEN _source_row % 59 = 0 THEN 500 ELSE container_count END",
        "weight_tons": "CASE WHEN _source_row % 53 = 0 THEN CAST(-1 AS DOUBLE) ELSE weight_tons END",
        "actual_delay_hours": "CASE WHEN _source_row % 47 = 0 THEN actual_delay_hours + 1 ELSE actual_delay_hours END",
        "on_time_flag": "CASE WHEN _source_row % 43 = 0 THEN NOT on_time_flag ELSE on_time_flag END",
        "transit_days_planned": "CASE WHEN _source_row % 41 = 0 THEN CAST(-2 AS DOUBLE) ELSE transit_days_planned END",
    },
    "_source_row % 37 = 0",
    "_source_row % 101 = 0",
)
DAMAGED_EVENTS = ({"port_code": "CASE WHEN _source_row % 29 = 0 THEN 'XX' ELSE port_code END"}, "_source_row % 37 = 0", "_source_row % 31 = 0")
DAMAGED_PORTS = ({"country": "CASE WHEN port_code = 'P03' THEN NULL ELSE country END"}, "port_code = 'P04'", "port_code = 'P05'")


def damaged(c: Curated) -> Curated:
    """Curated tables with the damage above; quarantined ones stay."""

    def broken(df: DataFrame, changes: dict[str, str], lost: str, again: str) -> DataFrame:
        new = df.select(*(F.expr(changes[x]).alias(x) if x in changes else F.col(x) for x in df.columns), F.expr(f"NOT ({lost})").alias("_kept"), F.expr(again).alias("_again"))
        return new.select(*df.columns, F.explode(F.expr("CASE WHEN _kept AND _again THEN array(1, 2) WHEN _kept OR _again THEN array(1) ELSE array() END"))).select(*df.columns)

    return Curated(broken(c.ports, *DAMAGED_PORTS), broken(c.shipments, *DAMAGED_SHIPMENTS), c.quarantined_shipments, broken(c.port_events, *DAMAGED_EVENTS), c.quarantined_events)


#: Tables that grow: where they are one file of one row group, a scan is one task, and what follows would be too.
_LARGE = ("lineitem", "orders", "events")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers test tables as views. Large ones of fewer splits than there are cores are dealt out to all."""
    cores = spark.sparkContext.defaultParallelism
    for n in names:
        rows = spark.read.parquet(f"{sf_dir}/{n}.parquet")
        if n in _LARGE and rows.rdd.getNumPartitions() < cores:
            rows = rows.repartition(cores)
        rows.createOrReplaceTempView(n)


#: The test tables that raw ones are made of.
INPUTS = ("nation", "region", "lineitem", "orders", "customer", "supplier", "part", "events")


def raw(spark: SparkSession, sf_dir: str) -> Raw:
    tables(spark, sf_dir, *INPUTS)
    return Raw(shipments=spark.sql(SHIPMENTS_SQL.replace(_JOINED, _JOINED_FOR_SPARK)), port_events=spark.sql(EVENTS_SQL), ports=spark.sql(PORTS_SQL))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
