"""Queries over the test tables, one or more for each family of operators, and the SQL that they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domain as D
from ..functions import columns
from ..functions.columns import blank_to_null, content_key, lax_double, lax_int, match_key, minutes_between, norm_code, seconds_between, strict_timestamp
from ..operators import curation as C
from ..operators import drift
from ..operators import learning as L
from ..operators import quality_checks as Q
from ..operators import serving as S
from ..operators import text_guard as T
from ..operators.categories import RareCategories
from ..operators.contract import violations
from ..operators.point_in_time import as_of, history
from ..operators.quantiles import counted_values, percentiles_of
from ..sources import fixtures as X
from ..sources.keyed import KeyedTable
from ..sources.layout import SortedTable, write_sorted
from ..sources.scratch import kept, kept_table, shared_folder
from ..sources.staging import code_key, staged
from ..streaming import activity, late
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 4, exact: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, integers as bigint, arrays joined by |: what can be compared across engines.

    exact names ratios of whole numbers: they are the same double everywhere, while rounding may tie and go either way.
    """
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        out.append((c if f.name in exact else F.round(c, digits) if kind in ("double", "float") else c.cast("bigint") if kind in ("int", "smallint", "tinyint") else F.array_join(c, "|") if kind == "array<string>" else c).alias(f.name))
    return df.select(*out)


def raw_tables(spark: SparkSession, sf_dir: str) -> C.Raw:
    """The raw tables, staged once for the same files and code."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in X.INPUTS]
    made = staged(spark, "raw", inputs, code_key(X, D), lambda: vars(X.raw(spark, sf_dir)))
    return C.Raw(**made)


def curated(spark: SparkSession, sf_dir: str) -> C.Curated:
    """The curated tables, from staged ones that all queries share."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in X.INPUTS]
    raw = raw_tables(spark, sf_dir)
    ports = C.curate_ports(raw.ports)
    both = staged(spark, "curated", inputs, code_key(X, D, C, columns), lambda: {"ports": ports, "shipments": C.stage_shipments(raw.shipments, ports, raw.shipments.count()), "port_events": C.stage_events(raw.port_events, ports)})
    return C.from_staged(both["ports"], both["shipments"], both["port_events"])


# ------------------------------------------------------------------------------------------------------------- serving
@query(O.query(O.SHIPMENTS, f"SELECT origin_port, destination_port, route_key, {O.STATS} FROM curated GROUP BY ALL"))
def route_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.route_stats(curated(spark, sf_dir).shipments), exact=("on_time_rate",))


@query(O.query(O.SHIPMENTS, "SELECT origin_port, destination_port, route_key, year(planned_departure) AS year, quarter(planned_departure) AS quarter, year(planned_departure) || '-Q' || quarter(planned_departure) AS period, count(*) AS shipment_count, count(actual_delay_hours) AS completed_count, round(avg(actual_delay_hours), 4) AS avg_delay_hours, avg(CAST(on_time_flag AS DOUBLE)) AS on_time_rate FROM curated GROUP BY ALL"))
def route_quarterly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.route_quarterly_stats(curated(spark, sf_dir).shipments), exact=("on_time_rate",))


@query(O.query(O.EVENTS, "SELECT port_code, CAST(event_timestamp AS DATE) AS event_date, count(*) AS event_count, count(*) FILTER (event_type = 'DELAYED') AS delayed_event_count, CAST(sum(delay_minutes) AS BIGINT) AS total_delay_minutes FROM curated_e GROUP BY ALL"))
def port_daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.port_daily_activity(curated(spark, sf_dir).port_events)


_CURATED = ", ".join(c for c in "shipment_id customer_id origin_port destination_port route_key vessel_id booking_date planned_departure actual_departure planned_arrival actual_arrival".split()) + ", CAST(container_count AS BIGINT) AS container_count, cargo_type, weight_tons, status, status_raw, round(actual_delay_hours, 4) AS actual_delay_hours, on_time_flag, round(transit_days_planned, 4) AS transit_days_planned, round(transit_days_actual, 4) AS transit_days_actual, round(booking_lead_days, 4) AS booking_lead_days, array_to_string(dq_flags, '|') AS dq_flags"


@query(O.query(O.SHIPMENTS, f"SELECT {_CURATED}, o.port_name AS origin_port_name, o.country AS origin_country, o.region AS origin_region, round(o.avg_congestion_score, 4) AS origin_congestion, d.port_name AS destination_port_name, d.country AS destination_country, d.region AS destination_region, round(d.avg_congestion_score, 4) AS destination_congestion FROM curated JOIN ports o ON o.port_code = origin_port JOIN ports d ON d.port_code = destination_port"))
def shipments_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curated(spark, sf_dir)
    return rounded(S.shipments_enriched(c.shipments, c.ports))


@query(O.query(O.SHIPMENTS, f"SELECT {O.STATS}, count(*) FILTER (on_time_flag) AS on_time_count FROM curated WHERE origin_port = 'P01' AND destination_port = 'P02' AND planned_departure >= TIMESTAMP '1996-01-01' AND planned_departure < TIMESTAMP '1998-01-01'"))
def single_route_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.single_route_stats(curated(spark, sf_dir).shipments, "P01", "P02", date(1996, 1, 1), date(1997, 12, 31)), exact=("on_time_rate",))


@query(O.query(O.SHIPMENTS, f"SELECT {O.STATS}, count(*) FILTER (on_time_flag) AS on_time_count FROM curated WHERE origin_port = 'P01' AND destination_port = 'NONE'"))
def empty_route_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.single_route_stats(curated(spark, sf_dir).shipments, "P01", "NONE"), exact=("on_time_rate",))


def _ranking_sql(order: str, where: str = "", group: str = "") -> str:
    return O.query(O.SHIPMENTS, f"SELECT route_key, origin_port, destination_port, shipment_count, completed_count, round(a, 4) AS avg_delay_hours, o AS on_time_rate FROM (SELECT route_key, origin_port, destination_port, count(*) AS shipment_count, count(actual_delay_hours) AS completed_count, avg(actual_delay_hours) AS a, avg(CAST(on_time_flag AS DOUBLE)) AS o FROM curated {where} GROUP BY ALL) WHERE completed_count >= 3 ORDER BY {order}, completed_count DESC, route_key LIMIT 10")


@query(_ranking_sql("a DESC NULLS LAST"))
def route_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.route_rankings(curated(spark, sf_dir).shipments), exact=("on_time_rate",))


@query(_ranking_sql("o ASC NULLS LAST", "WHERE year(planned_departure) = 1997 AND quarter(planned_departure) = 2"))
def route_rankings_quarter_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.route_rankings(curated(spark, sf_dir).shipments, "on_time_rate", descending=False, period="1997-Q2"), exact=("on_time_rate",))


@query(O.query(O.SHIPMENTS, "SELECT period, quarter_start, shipments, completed, quarter_start >= lo AND quarter_start + INTERVAL 3 MONTH <= hi AS complete FROM (SELECT year(planned_departure) || '-Q' || quarter(planned_departure) AS period, CAST(min(date_trunc('quarter', planned_departure)) AS TIMESTAMP) AS quarter_start, count(*) AS shipments, count(actual_delay_hours) AS completed FROM curated GROUP BY 1), (SELECT date_trunc('day', min(planned_departure)) AS lo, max(planned_departure) AS hi FROM curated)"))
def period_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.period_coverage(curated(spark, sf_dir).shipments)


@query(O.query(O.SHIPMENTS, "SELECT shipment_id, booking_date, status, cargo_type FROM curated WHERE status = 'DELAYED' AND cargo_type = 'Machinery' AND planned_departure >= TIMESTAMP '1996-01-01' AND planned_departure < TIMESTAMP '1999-01-01' ORDER BY booking_date DESC NULLS LAST, shipment_id LIMIT 20 OFFSET 20"))
def shipment_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = S.shipment_page(curated(spark, sf_dir).shipments, {"status": "DELAYED", "cargo_type": "Machinery"}, date(1996, 1, 1), date(1998, 12, 31), page=2)
    return rows.select("shipment_id", "booking_date", "status", "cargo_type")


@query(O.query(O.SHIPMENTS, "SELECT count(*) AS total FROM curated WHERE status = 'DELAYED'"))
def shipment_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shipment_page(curated(spark, sf_dir).shipments, {"status": "DELAYED"})[1]


@query(O.query(O.SHIPMENTS, "SELECT shipment_id, route_key, status, o.region AS origin_region FROM curated JOIN ports o ON o.port_code = origin_port WHERE shipment_id = 'SHP-7-3'"))
def shipment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curated(spark, sf_dir)
    return S.shipment_lookup(c.shipments, c.ports, " shp-7-3 ").select("shipment_id", "route_key", "status", "origin_region")


@query(O.query(O.PORTS, "SELECT port_code, port_name, country, region, timezone, round(avg_congestion_score, 4) AS avg_congestion_score FROM ports"))
def ports_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curated(spark, sf_dir).ports.drop("dq_flags"))


@query(O.query(O.PORTS, "SELECT port_code FROM ports WHERE port_code IN ('P01', 'P02', 'P99')"))
def semi_join_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.known_ports(curated(spark, sf_dir).ports, ["P01", "P02", "P99"])


# ------------------------------------------------------------------------------------------------------------ curation
@query(O.query(O.SHIPMENTS, f"SELECT {_CURATED}, _source_row FROM curated"))
def shipment_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curated(spark, sf_dir).shipments)


@query(O.query(O.SHIPMENTS, "SELECT shipment_id, origin_port, destination_port, quarantine_reason, _row_number FROM staged WHERE quarantine_reason IS NOT NULL"))
def shipment_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated(spark, sf_dir).quarantined_shipments.select("shipment_id", "origin_port", "destination_port", "quarantine_reason", "_row_number")


@query(O.query(O.EVENTS, "SELECT event_key, event_id, event_timestamp, port_code, vessel_id, event_type, CAST(delay_minutes AS BIGINT) AS delay_minutes, notes, array_to_string(dq_flags, '|') AS dq_flags, _source_row FROM curated_e"))
def event_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curated(spark, sf_dir).port_events)


@query(O.query(O.EVENTS, "SELECT event_key, event_id, collides AS event_id_collision, quarantine_reason, _row_number FROM staged_e WHERE quarantine_reason IS NOT NULL"))
def event_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated(spark, sf_dir).quarantined_events.select("event_key", "event_id", "event_id_collision", "quarantine_reason", "_row_number")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem GROUP BY ALL")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    twice = rows.unionByName(rows.where("l_linenumber < 4"))
    return C.first_rows(twice, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def conflicting_id_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "lineitem")
    return C.first_rows(rows, ["l_orderkey", "l_linenumber"], "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(O.query(O.SHIPMENTS, "SELECT status_raw, status, count(*) AS n FROM curated GROUP BY ALL"))
def status_rederive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated(spark, sf_dir).shipments.groupBy("status_raw", "status").agg(F.count("*").alias("n"))


@query(O.query(O.SHIPMENTS, "SELECT flag, count(*) AS n FROM (SELECT unnest(dq_flags) AS flag FROM curated) GROUP BY flag"))
def flag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated(spark, sf_dir).shipments.select(F.explode("dq_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query(O.query(O.BOTH, "SELECT 'shipments' AS dataset, reason AS quarantine_reason, count(*) AS n FROM verdicts GROUP BY ALL UNION ALL SELECT 'port_events', reason, count(*) FROM verdicts_e GROUP BY ALL"))
def quarantine_reasons_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curated(spark, sf_dir)
    one = lambda df, name: df.groupBy("quarantine_reason").agg(F.count("*").alias("n")).select(F.lit(name).alias("dataset"), "quarantine_reason", "n")
    return one(c.quarantined_shipments, "shipments").unionByName(one(c.quarantined_events, "port_events"))


#: Each customer's balance, in ways that are numbers and ways that are none.
_LAX = "CASE c_custkey % 7 WHEN 0 THEN CAST(c_acctbal AS STRING) WHEN 1 THEN concat('  ', CAST(c_acctbal AS STRING), ' ') WHEN 2 THEN concat(CAST(c_acctbal AS STRING), 'd') WHEN 3 THEN concat(CAST(c_custkey AS STRING), 'e2') WHEN 4 THEN c_name WHEN 5 THEN '' ELSE concat('+', CAST(c_custkey AS STRING), '.5') END"


@query(f"SELECT c_custkey, CAST(TRY_CAST(v AS INTEGER) AS BIGINT) AS i, TRY_CAST(v AS DOUBLE) AS d FROM (SELECT c_custkey, trim({_LAX}) AS v FROM customer)")
def lax_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.table(spark, sf_dir, "customer").select("c_custkey", F.expr(_LAX).alias("v"))
    return v.select("c_custkey", lax_int("v").cast("bigint").alias("i"), lax_double("v").alias("d"))


#: Each order's date, padded, unpadded with a time made of its keys, with a T, and with a zone.
_STRICT = "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS STRING) WHEN 1 THEN concat(CAST(year(o_orderdate) AS STRING), '-', CAST(month(o_orderdate) AS STRING), '-', CAST(day(o_orderdate) AS STRING), ' ', CAST(o_orderkey % 24 AS STRING), ':', CAST(o_custkey % 60 AS STRING), ':', CAST(o_orderkey % 60 AS STRING)) WHEN 2 THEN replace(CAST(o_orderdate AS STRING), ' ', 'T') ELSE concat(CAST(o_orderdate AS STRING), ' UTC') END"


@query(f"SELECT o_orderkey, TRY_STRPTIME(v, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT o_orderkey, {_STRICT} AS v FROM orders)")
def strict_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "orders").select("o_orderkey", strict_timestamp(F.expr(_STRICT)).alias("ts"))


@query("SELECT event_id, date_diff('minute', TIMESTAMP '2024-01-01', ts) AS minutes, round(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6, 3) AS seconds FROM events")
def minute_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return X.table(spark, sf_dir, "events").select("event_id", minutes_between(start, F.col("ts")).alias("minutes"), F.round(seconds_between(start, F.col("ts")), 3).alias("seconds"))


@query("SELECT c_custkey, upper(trim(concat(' ', c_mktsegment, ' '))) AS code, nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END), '') AS name, lower(trim(regexp_replace(concat(c_mktsegment, '  x '), '\\s+', ' ', 'g'))) AS key, regexp_matches(c_name, '^Customer#[0-9]{9}$') AS formatted FROM customer")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.table(spark, sf_dir, "customer")
    return c.select("c_custkey", norm_code(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("code"), blank_to_null(F.expr("CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END")).alias("name"), match_key(F.concat("c_mktsegment", F.lit("  x "))).alias("key"), F.col("c_name").rlike("^Customer#[0-9]{9}$").alias("formatted"))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def anti_join_unknown_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = X.table(spark, sf_dir, "nation").where("n_regionkey < 3")
    return X.table(spark, sf_dir, "supplier").join(C.small(nations), F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select("s_suppkey")


# ------------------------------------------------------------------------------------------------- contract and checks
@query(O.CONTRACT)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over damaged tables, so that every rule but curated_not_empty has violations."""
    return violations(raw_tables(spark, sf_dir), X.damaged(curated(spark, sf_dir)))


@query(O.query(O.SHIPMENTS, "SELECT (SELECT count(*) FROM rs) AS raw_rows, (SELECT count(*) FROM once) AS distinct_rows, (SELECT count(*) FROM curated) AS curated_rows, (SELECT count(*) FROM verdicts) AS quarantined_rows"))
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, c = raw_tables(spark, sf_dir), curated(spark, sf_dir)
    counts = (("raw_rows", raw.shipments), ("distinct_rows", raw.shipments.select(content_key(*D.SHIPMENT_COLUMNS)).distinct()), ("curated_rows", c.shipments), ("quarantined_rows", c.quarantined_shipments))
    return reduce(lambda a, b: a.join(F.broadcast(b)), [df.agg(F.count("*").alias(n)) for n, df in counts])


@query(O.check_counts())
def dq_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.mask_counts(raw_tables(spark, sf_dir))


@query(O.check_counts())
def dq_all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.mask_counts(raw_tables(spark, sf_dir))


@query(O.query(O.SHIPMENTS, "SELECT shipment_id AS sample_key FROM rs WHERE TRY_CAST(container_count AS INT) > 100 GROUP BY 1 ORDER BY 1 LIMIT 10"))
def dq_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.samples(raw_tables(spark, sf_dir), "shipments.container_count_outlier")


@query("""SELECT count(*) AS n FROM (SELECT l_orderkey, date_diff('microsecond', o_orderdate, l_shipdate) / 86400e6 AS t, s_nationkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey) x
JOIN (SELECT s_nationkey AS k, median(date_diff('microsecond', o_orderdate, l_shipdate) / 86400e6) AS m, count(*) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) y USING (k) WHERE c >= 5 AND abs(t - m) / nullif(m, 0) > 0.5""")
def dq_transit_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "lineitem").join(X.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(X.table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select(F.col("s_nationkey").alias("k"), (seconds_between("o_orderdate", "l_shipdate") / F.lit(86400.0)).alias("t"))
    transits = kept(counted_values(rows, ["k"], "t"))
    medians = percentiles_of(transits, ["k"], [0.5]).select("k", F.col("q")[0].alias("m")).join(transits.groupBy("k").agg(F.sum("n").alias("c")), "k")
    return rows.join(medians, "k").where("c >= 5 AND abs(t - m) / nullif(m, 0) > 0.5D").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM (SELECT value, lag(value) OVER (ORDER BY event_id) AS before FROM events) WHERE value < before")
def dq_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "events").withColumnRenamed("event_id", "_row_number")
    return Q.with_previous(rows, F.col("value"), "before").where("value < before").agg(F.count("*").alias("n"))


_PROFILED = "p AS (SELECT CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment, CASE WHEN c_custkey % 50 = 0 THEN 'never' WHEN c_custkey % 9 = 0 THEN ' ' ELSE '2024-01-0' || (1 + c_custkey % 5) || ' 10:00:00' END AS seen, '' AS note FROM customer)"


def _profile_sql(c: str) -> str:
    said, number, at = f"nullif(trim({c}), '')", f"TRY_CAST(trim({c}) AS DOUBLE)", f"TRY_STRPTIME(trim({c}), '%Y-%m-%d %H:%M:%S')"
    return f"""SELECT *, CASE inferred_type WHEN 'numeric' THEN said - numbers WHEN 'timestamp' THEN said - times END AS unparseable FROM (SELECT *, CASE WHEN said = 0 THEN 'empty' WHEN numbers >= 0.95 * said THEN 'numeric' WHEN times >= 0.95 * said THEN 'timestamp' ELSE 'string' END AS inferred_type FROM (
SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({said}) AS blanks, count(DISTINCT {said}) AS "distinct", round(count({number}) / nullif(CAST(count({said}) AS DOUBLE), 0), 4) AS numeric_share, min({number}) AS min, round(median({number}), 4) AS median, max({number}) AS max,
count({said}) AS said, count({number}) AS numbers, count({at}) AS times, min({at}) AS first_time, max({at}) AS last_time FROM p))"""


@query(f"WITH {_PROFILED} SELECT * EXCLUDE (said, numbers, times) FROM ({' UNION ALL '.join(_profile_sql(c) for c in ('c_acctbal', 'c_mktsegment', 'seen', 'note'))})")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.expr("CASE WHEN c_custkey % 50 = 0 THEN 'never' WHEN c_custkey % 9 = 0 THEN ' ' ELSE concat('2024-01-0', 1 + c_custkey % 5, ' 10:00:00') END")
    rows = X.table(spark, sf_dir, "customer").select(F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_mktsegment", seen.alias("seen"), F.lit("").alias("note"))
    return rounded(Q.column_profile(rows, rows.columns))


@query("SELECT event_type AS value, count(*) AS rows, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM events), 4) AS share FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.top_values(X.table(spark, sf_dir, "events"), "event_type", 3))


@query("SELECT event_type AS \"check\", n AS rows_affected, b AS baseline_rows FROM (SELECT event_type, count(*) AS n, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 10 WHEN 'error' THEN 1000000000 END AS b FROM events GROUP BY 1) WHERE n > coalesce(b, 0) * 1.1")
def gate_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = X.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("check")).agg(F.count("*").alias("rows_affected"))
    return rounded(Q.regressions(now, spark.createDataFrame([("view", 0), ("click", 10), ("error", 1_000_000_000)], "check string, rows_affected int")))


# --------------------------------------------------------------------------------------------------------- point in time
@query("""SELECT o_orderkey, round((SELECT avg(l_quantity) FROM lineitem l JOIN orders p ON l.l_orderkey = p.o_orderkey WHERE p.o_custkey = o.o_custkey AND l.l_shipdate < o.o_orderdate), 4) AS mean_before,
(SELECT count(*) FROM lineitem l JOIN orders p ON l.l_orderkey = p.o_orderkey WHERE p.o_custkey = o.o_custkey AND l.l_shipdate < o.o_orderdate AND l.l_shipdate >= o.o_orderdate - INTERVAL 30 DAY) AS n_30d FROM orders o""")
def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders")
    facts = X.table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("key"), F.col("l_shipdate").alias("ts"), "l_quantity")
    probes = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("ts"))
    out = as_of(probes, facts, {"mean_before": ("avg", "l_quantity", None), "n_30d": ("count", "l_quantity", 30)}, number=X.table(spark, sf_dir, "lineitem").count() + 2 * o.count())
    return rounded(out.select(F.col("id").alias("o_orderkey"), "mean_before", "n_30d"))


@query("SELECT event_id, round((SELECT avg(CAST(f.value * 100 AS BIGINT)) FROM events f WHERE f.user_id = e.user_id AND f.ts < e.ts AND f.ts >= e.ts - INTERVAL 3 DAY), 4) AS mean_3d, (SELECT count(*) FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'error' AND f.ts < e.ts AND f.ts >= e.ts - INTERVAL 3 DAY) AS errors_3d FROM events e")
def event_lookback_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events")
    facts = e.select(F.col("user_id").alias("key"), "ts", F.round(F.col("value") * 100).cast("bigint").alias("value"), (F.col("event_type") == "error").cast("bigint").alias("error"))
    out = as_of(e.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts"), facts, {"mean_3d": ("avg", "value"), "errors_3d": ("total", "error")}, 3)
    return rounded(out.select(F.col("id").alias("event_id"), "mean_3d", "errors_3d"))


@query(O.HISTORY)
def shipment_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curated(spark, sf_dir)
    out = history(c.shipments, c.port_events)
    return rounded(out, exact=tuple(out.columns))


# -------------------------------------------------------------------------------------------------------------- learning
@query(O.query(O.SHIPMENTS, """SELECT shipment_id, origin_port, destination_port, cargo_type, o.region AS origin_region, d.region AS destination_region, o.region || '->' || d.region AS region_lane, CAST(container_count AS DOUBLE) AS container_count, weight_tons,
round(date_diff('microsecond', booking_date, planned_departure) / 86400e6, 4) AS booking_lead_days, round(date_diff('microsecond', planned_departure, planned_arrival) / 86400e6, 4) AS transit_days_planned, round(o.avg_congestion_score, 4) AS origin_congestion,
round(d.avg_congestion_score, 4) AS destination_congestion, CAST(month(planned_departure) AS DOUBLE) AS departure_month, CAST(isodow(planned_departure) - 1 AS DOUBLE) AS departure_dayofweek, CAST(isodow(booking_date) - 1 AS DOUBLE) AS booking_dayofweek
FROM curated JOIN ports o ON o.port_code = origin_port JOIN ports d ON d.port_code = destination_port"""))
def features_booking(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curated(spark, sf_dir)
    return rounded(L.booking_features(c.shipments, c.ports, keep=("shipment_id",)))


_FOLDS = """o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), f AS (SELECT unnest([0, 1, 2, 3]) AS fold),
m AS (SELECT fold, o_orderkey, CASE WHEN i < begin + (n - begin) * fold // 4 THEN 'train' WHEN i < begin + (n - begin) * (fold + 1) // 4 THEN 'test' END AS part FROM (SELECT *, CAST(floor(n * 0.4) AS BIGINT) AS begin FROM o), f)"""


@query(f"WITH {_FOLDS} SELECT fold, count(*) FILTER (part = 'train') AS train_rows, count(*) FILTER (part = 'test') AS test_rows FROM m GROUP BY fold")
def rolling_origin_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.fold_sizes(L.rolling_folds(X.table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"])))


@query(f"WITH {_FOLDS} SELECT CAST(fold AS BIGINT) AS fold, o_orderkey, part FROM m WHERE part IS NOT NULL")
def fold_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.rolling_folds(X.table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"]).select("fold", "o_orderkey", "part"))


@query(f"WITH {_FOLDS}, s AS (SELECT fold, CAST(o_orderstatus = 'F' AS INT) AS y, least(o_totalprice / 500000.0, 1.0) AS p FROM m JOIN orders USING (o_orderkey) WHERE part = 'test'), g AS (SELECT fold, avg((p - y) * (p - y)) AS brier, avg(y) AS rate FROM s GROUP BY fold) SELECT round(avg(brier), 4) AS brier_mean, round(stddev_pop(brier), 4) AS brier_std, round(avg(rate), 4) AS rate_mean, round(stddev_pop(rate), 4) AS rate_std FROM g")
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population standard deviation over folds of two metrics of a fixed score."""
    rows = X.table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.least(F.col("o_totalprice") / F.lit(500000.0), F.lit(1.0)).alias("p"))
    found = L.rolling_folds(rows, ["o_orderdate", "o_orderkey"]).where("part = 'test'").groupBy("fold").agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), F.avg("y").alias("rate"))
    return rounded(found.agg(*(f(c).alias(f"{c}_{n}") for c in ("brier", "rate") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std")))))


_SCORES = "s AS (SELECT CAST(event_type IN ('error', 'view') AS INT) AS y, least(value / 100.0, 1.0) AS p FROM events)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "events").select(F.col("event_type").isin("error", "view").cast("int").alias("y"), F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("p"))


@query(f"""WITH {_SCORES}, f AS (SELECT count(*) AS n, sum(y) AS pos, count(*) FILTER (p >= 0.5) AS pred, coalesce(sum(y) FILTER (p >= 0.5), 0) AS tp, avg((p - y) * (p - y)) AS brier FROM s),
g AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY p), r AS (SELECT pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM g)
SELECT round(CASE WHEN pred > 0 THEN tp / pred ELSE 0 END, 4) AS precision, round(CASE WHEN pos > 0 THEN tp / pos ELSE 0 END, 4) AS recall, round(CASE WHEN pred + pos > 0 THEN 2 * tp / (pred + pos) ELSE 0 END, 4) AS f1,
(SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 4) FROM r) AS roc_auc, (SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 4) FROM r) AS average_precision, round(brier, 4) AS brier, round(pos / n, 4) AS positive_rate, round(pred / n, 4) AS predicted_rate FROM f""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.classification_metrics(_scores(spark, sf_dir)))


@query(f"""WITH {_SCORES}, t AS (SELECT unnest([0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7]::DOUBLE[]) AS threshold), c AS (SELECT threshold, count(*) AS n, sum(y) AS pos, count(*) FILTER (p >= threshold) AS pred, coalesce(sum(y) FILTER (p >= threshold), 0) AS tp FROM s, t GROUP BY threshold)
SELECT threshold, round(CASE WHEN pred > 0 THEN tp / pred ELSE 0 END, 4) AS precision, round(CASE WHEN pos > 0 THEN tp / pos ELSE 0 END, 4) AS recall, round(CASE WHEN pred + pos > 0 THEN 2 * tp / (pred + pos) ELSE 0 END, 4) AS f1, round(pred / n, 4) AS predicted_rate FROM c""")
def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.threshold_table(_scores(spark, sf_dir)))


@query(f"WITH {_SCORES} SELECT least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS rows, round(avg(p), 4) AS mean_score, round(avg(y), 4) AS observed FROM s GROUP BY 1")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.calibration_bins(_scores(spark, sf_dir)))


@query(f"WITH {_SCORES} SELECT CASE WHEN p >= 0.5 THEN 'HIGH' WHEN p >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS band, count(*) AS n FROM s GROUP BY 1")
def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).groupBy(L.risk_band(F.col("p")).alias("band")).agg(F.count("*").alias("n"))


#: Shares floored at 1e-4, brought back to sum 1, compared.
_PSI_SQL = """z AS (SELECT greatest(e, 1e-4) AS e, greatest(a, 1e-4) AS a FROM sides), n AS (SELECT e / (SELECT sum(e) FROM z) AS e, a / (SELECT sum(a) FROM z) AS a FROM z) SELECT round(sum((a - e) * ln(a / e)), 4) AS psi FROM n"""
_OLD, _NEW = "ts < TIMESTAMP '2024-01-11'", "ts >= TIMESTAMP '2024-01-21'"


def _numeric_psi_sql(v: str) -> str:
    """Bins [edge, next edge) between the distinct deciles, of which the least and the greatest stand for no bound at all."""
    share = lambda t: f"(SELECT count(*) FROM {t} WHERE (lo IS NULL OR v >= lo) AND (hi IS NULL OR v < hi)) / (SELECT CAST(count(v) AS DOUBLE) FROM {t})"
    return f"""WITH r AS (SELECT {v} AS v FROM events WHERE {_OLD} AND {v} IS NOT NULL), c AS (SELECT {v} AS v FROM events WHERE {_NEW} AND {v} IS NOT NULL),
d AS (SELECT DISTINCT unnest(quantile_cont(CAST(v AS DOUBLE), [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS edge FROM r),
b AS (SELECT CASE WHEN edge > (SELECT min(edge) FROM d) THEN edge END AS lo, CASE WHEN above < (SELECT max(edge) FROM d) THEN above END AS hi FROM (SELECT edge, lead(edge) OVER (ORDER BY edge) AS above FROM d) WHERE above IS NOT NULL),
sides AS (SELECT round({share('r')}, 6) AS e, {share('c')} AS a FROM b), {_PSI_SQL}"""


@query(_numeric_psi_sql("value"))
def psi_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events")
    return rounded(drift.psi_numeric(e.where("ts < TIMESTAMP_NTZ '2024-01-11'"), e.where("ts >= TIMESTAMP_NTZ '2024-01-21'"), "value"))


_TIED = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 0 ELSE floor(value / 10) + CASE WHEN ts >= TIMESTAMP '2024-01-21' THEN event_id % 2 ELSE 0 END END"


@query(_numeric_psi_sql(f"({_TIED})"))
def psi_numeric_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over values with many ties and nulls."""
    e = X.table(spark, sf_dir, "events").select("ts", F.expr(_TIED.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")).cast("double").alias("v"))
    return rounded(drift.psi_numeric(e.where("ts < TIMESTAMP_NTZ '2024-01-11'"), e.where("ts >= TIMESTAMP_NTZ '2024-01-21'"), "v"))


def _categorical_psi_sql(v: str) -> str:
    """The thirty most frequent categories, null among them, and all others together."""
    return f"""WITH r AS (SELECT coalesce(CAST({v} AS VARCHAR), 'NULL') AS v FROM events WHERE {_OLD}), c AS (SELECT coalesce(CAST({v} AS VARCHAR), 'NULL') AS v FROM events WHERE {_NEW}),
t AS (SELECT v, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM r) AS e FROM r GROUP BY v ORDER BY count(*) DESC, v LIMIT 30),
u AS (SELECT t.v, any_value(e) AS e, count(c.v) / (SELECT CAST(count(*) AS DOUBLE) FROM c) AS a FROM t LEFT JOIN c ON c.v = t.v GROUP BY t.v),
sides AS (SELECT round(e, 6) AS e, a FROM u UNION ALL SELECT round(1 - sum(e), 6), 1 - sum(a) FROM u), {_PSI_SQL}"""


@query(_categorical_psi_sql("event_type"))
def psi_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events")
    return rounded(drift.psi_categorical(e.where("ts < TIMESTAMP_NTZ '2024-01-11'"), e.where("ts >= TIMESTAMP_NTZ '2024-01-21'"), "event_type"))


_MANY = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id % 45 END"


@query(_categorical_psi_sql(_MANY))
def psi_categorical_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over more categories than are kept, and nulls."""
    e = X.table(spark, sf_dir, "events").select("ts", F.expr(_MANY).alias("v"))
    return rounded(drift.psi_categorical(e.where("ts < TIMESTAMP_NTZ '2024-01-11'"), e.where("ts >= TIMESTAMP_NTZ '2024-01-21'"), "v"))


# --------------------------------------------------------------------------------------------------- text and streaming
@query("""SELECT conv_id, turn, array_to_string(cited, '|') AS cited, NOT fig OR len(cited) > 0 AS grounded FROM (SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(t, '\\[(S[0-9]+)\\]', 1))) AS cited,
regexp_matches(regexp_replace(t, '\\[S[0-9]+\\]|\\b(SHP|CUST|VSL|EVT)-[0-9]+\\b|\\b[0-9]{4}-Q[1-4]\\b|\\b[A-Z]{5}\\b', ' ', 'g'), '[0-9]') AS fig FROM (SELECT conv_id, turn, concat(text, CASE WHEN turn % 2 = 0 THEN ' [S1] SHP-12' ELSE ' 2024-Q1' END) AS t FROM conversations))""")
def grounding_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "conversations").withColumn("answer", F.concat("text", F.expr("CASE WHEN turn % 2 = 0 THEN ' [S1] SHP-12' ELSE ' 2024-Q1' END"))).withColumn("sources", F.array(F.lit("S1")))
    return rounded(T.grounding(rows).select("conv_id", "turn", "cited", "grounded"))


@query("""SELECT role, conv_id, round(sum(CASE role WHEN 'user' THEN (length(text) - least(length(text), turn * 20)) * 3.0 + least(length(text), turn * 20) * 0.3 + turn * 15.0
WHEN 'assistant' THEN (length(text) - least(length(text), turn * 20)) * 0.8 + least(length(text), turn * 20) * 0.1 + turn * 4.0 END) / 1e6, 8) AS cost_usd FROM conversations GROUP BY role, conv_id""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each role of each conversation costs: two priced models, cached tokens, and roles without a price."""
    n = F.length("text")
    usage = X.table(spark, sf_dir, "conversations").select("role", "conv_id", F.col("role").alias("model"), n.alias("input_tokens"), F.col("turn").alias("output_tokens"), F.least(n, F.col("turn") * 20).alias("cached_tokens"))
    prices = spark.createDataFrame([("user", 3.0, 15.0, 0.3), ("assistant", 0.8, 4.0, 0.1)], "model string, input double, output double, cached double")
    return rounded(T.token_cost(usage, prices).groupBy("role", "conv_id").agg(F.sum("cost_usd").alias("cost_usd")), 8)


@query("SELECT CAST(ts AS DATE) AS event_date, event_type, count(*) AS event_count, count(*) FILTER (event_type = 'error') AS error_count FROM events GROUP BY ALL")
def stream_dedup_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a feed that delivers some events two or three times."""
    out = activity.run_to_table(activity.daily(activity.with_replays(activity.read_events(spark, sf_dir))), spark)
    return out.select(F.to_date("w.start").alias("event_date"), "event_type", "event_count", "error_count")


# ------------------------------------------------------------------------------------------- layout, merges and late rows
@query(O.query(O.SHIPMENTS, "SELECT shipment_id, route_key, status, planned_departure FROM curated WHERE shipment_id IN ('SHP-7-3', 'SHP-1-1', 'SHP-2-1', 'SHP-3-2', 'NONE')"))
def sorted_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups that open the files of a sorted table which can have the ids."""
    ids = ("SHP-7-3", "SHP-1-1", "SHP-2-1", "SHP-3-2", "NONE")
    return _by_id(spark, sf_dir).where_key(*ids).select("shipment_id", "route_key", "status", "planned_departure")


@query(O.query(O.SHIPMENTS, "SELECT shipment_id, route_key FROM curated ORDER BY shipment_id LIMIT 50 OFFSET (SELECT count(*) // 100 * 50 FROM curated)"))
def sorted_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page in the middle of all shipments, by the counts of a sorted table's files."""
    table = _by_id(spark, sf_dir)
    return table.page(table.whole.count() // 100 + 1, 50).select("shipment_id", "route_key")


def _by_id(spark: SparkSession, sf_dir: str) -> SortedTable:
    folder = f"{shared_folder(spark)}/by-id-{uuid.uuid4().hex}"
    rows = curated(spark, sf_dir).shipments
    n = rows.count()
    write_sorted(rows, folder, ["shipment_id"], min(max(n // 20, 1), C.PARTITION_ROWS), ("shipment_id",), n)
    return SortedTable(spark, folder)


@query(O.query(O.SHIPMENTS, "SELECT shipment_id, booking_date, status FROM curated WHERE status = 'DELAYED' ORDER BY booking_date DESC NULLS LAST, shipment_id LIMIT 20 OFFSET 40"))
def seek_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page, each found by the last row of the one before it."""
    rows, cursor = curated(spark, sf_dir).shipments, None
    for _ in range(2):
        last = S.next_page(rows, cursor, {"status": "DELAYED"}).tail(1)
        cursor = (last[0].booking_date, last[0].shipment_id) if last else cursor
    return S.next_page(rows, cursor, {"status": "DELAYED"}).select("shipment_id", "booking_date", "status")


@query(O.query(O.SHIPMENTS, "SELECT shipment_id, o.port_code AS origin_code, o.region AS origin_region, d.port_name AS destination_name, round(d.avg_congestion_score, 4) AS destination_congestion FROM curated JOIN ports o ON o.port_code = origin_port JOIN ports d ON d.port_code = destination_port"))
def shipment_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments with their ports as structs."""
    c = curated(spark, sf_dir)
    out = S.shipment_details(c.shipments, c.ports)
    return rounded(out.select("shipment_id", F.col("origin.port_code").alias("origin_code"), F.col("origin.region").alias("origin_region"), F.col("destination.port_name").alias("destination_name"), F.col("destination.avg_congestion_score").alias("destination_congestion")))


@query("""WITH b AS (SELECT user_id, event_id % 4 AS batch, count(*) AS n, max(ts) AS last_ts, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events WHERE user_id % 3 <> event_id % 4 OR event_id % 4 = 0 GROUP BY ALL)
SELECT user_id, CAST(batch AS BIGINT) AS batch, n, last_ts, CAST(cents AS BIGINT) AS cents FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY batch DESC) = 1""")
def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches of sums by user merged one after the other, the third one twice: each user's last one stays."""
    table = KeyedTable(spark, f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}", ["user_id"], 8)
    rows = X.table(spark, sf_dir, "events").withColumn("batch", (F.col("event_id") % 4).cast("bigint")).where("user_id % 3 <> batch OR batch = 0")
    sums = rows.groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    for batch in (0, 1, 2, 2, 3):
        table.merge(sums.where(F.col("batch") == batch), batch)
    return table.read()


#: A feed in batches by time, some rows one batch later than most, some delivered again.
_DELIVERED = """(SELECT event_id, ts, event_type, day(ts) // 8 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS batch FROM events
UNION ALL SELECT event_id, ts, event_type, day(ts) // 8 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END + 1 FROM events WHERE event_id % 7 = 0)"""


@query(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY batch) AS nth FROM {_DELIVERED}), g AS (SELECT event_type, batch, max(ts) AS top FROM d GROUP BY ALL),
k AS (SELECT event_type, batch, max(top) OVER (PARTITION BY event_type ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM g)
SELECT event_id, event_type, CASE WHEN ts < top - INTERVAL 10 DAY THEN 'late' WHEN nth > 1 THEN 'replay' ELSE 'kept' END AS verdict, coalesce(ts < top, false) AS out_of_order FROM d JOIN k USING (event_type, batch)""")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All delivered rows of a feed in batches, told apart by a stateful operator: kept, replays and late ones."""
    folder = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    X.tables(spark, sf_dir, "events")
    fed = kept_table(spark.sql(f"SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type, batch FROM {_DELIVERED.replace('day(ts) // 8', 'day(ts) div 8')}"))
    for batch in range(6):  # the stream takes all files of a batch at once, then stops
        fed.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(fed.drop("batch").schema).parquet(f"{folder}/in")
        out = late.sorted_out(stream, "event_type", ("event_id", "ts", "event_type"), lateness=timedelta(days=10))
        out.writeStream.foreachBatch(late.sides(f"{folder}/out")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return late.read_sides(spark, f"{folder}/out").select("event_id", "event_type", "verdict", "out_of_order")


@query("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), t AS (SELECT CASE WHEN n >= 12 THEN CAST(e.user_id AS VARCHAR) ELSE 'infrequent' END AS name, e.event_id FROM events e JOIN c USING (user_id))
SELECT name, count(*) AS n FROM t GROUP BY name""")
def rare_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of fewer than 12 events as one, by a fitted estimator."""
    rows = X.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"))
    model = RareCategories(inputCols=["user"], outputCols=["name"], minRows=12).fit(rows)
    return model.transform(rows).groupBy("name").agg(F.count("*").alias("n"))
