"""What is served from curated tables: statistics by route, quarter and day, rankings, coverage, pages, look-ups."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import domain as D
from ..sources.layout import after
from ..sources.scratch import kept
from .curation import small
from .quantiles import percentiles_of


def _outcomes(shipments: DataFrame, keys: list[str], percentiles: bool = True) -> DataFrame:
    """Exact statistics of each group, one row of zero counts if there are no keys and no rows.

    Rows are added up by delay first, so a route with most of all rows is a few values by the time it is one group, and
    its percentiles are selected by rank.
    """
    late, dep = F.col("actual_delay_hours"), F.col("planned_departure")
    parts = shipments.groupBy(*keys, "actual_delay_hours").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "CANCELLED").alias("cancelled"), F.count("on_time_flag").alias("judged"), F.count_if(F.col("on_time_flag")).alias("on_time"), F.min(dep).alias("first"), F.max(dep).alias("last")
    )
    parts = kept(parts) if percentiles else parts
    done = F.sum(F.when(late.isNotNull(), F.col("n")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    stats = parts.groupBy(*keys).agg(
        zero(F.sum("n")).alias("shipment_count"), zero(done).alias("completed_count"), zero(F.sum("cancelled")).alias("cancelled_count"),
        (F.sum(late * F.col("n")) / done).alias("avg_delay_hours"), (F.sum("on_time") / F.nullif(F.sum("judged"), F.lit(0))).alias("on_time_rate"), zero(F.sum("on_time")).alias("on_time_count"),
        F.min("first").alias("first_planned_departure"), F.max("last").alias("last_planned_departure"),
    )
    if not percentiles:
        return stats
    q = percentiles_of(parts.where(late.isNotNull()).select(*keys, late.cast("double").alias("value"), "n"), keys, [0.5, 0.9])
    same = reduce(lambda a, b: a & b, (F.col(f"s.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys), F.lit(True))
    return stats.alias("s").join(q.alias("q"), same, "left").select("s.*", F.get("q.q", F.lit(0)).alias("median_delay_hours"), F.get("q.q", F.lit(1)).alias("p90_delay_hours"))


_ROUTE = ["origin_port", "destination_port", "route_key"]
_STATS = ["shipment_count", "completed_count", "cancelled_count", "avg_delay_hours", "median_delay_hours", "p90_delay_hours", "on_time_rate", "first_planned_departure", "last_planned_departure"]


def route_stats(shipments: DataFrame) -> DataFrame:
    """Exact statistics of each route; the on-time rate is over completed shipments."""
    return _outcomes(shipments, _ROUTE).select(*_ROUTE, *_STATS)


def _quarter(c: str = "planned_departure") -> list[Column]:
    y, q = F.year(c).cast("bigint"), F.quarter(c).cast("bigint")
    return [y.alias("year"), q.alias("quarter"), F.concat(y, F.lit("-Q"), q).alias("period")]


def route_quarterly_stats(shipments: DataFrame) -> DataFrame:
    keys = [*_ROUTE, "year", "quarter", "period"]
    rows = shipments.select("*", *_quarter())
    return _outcomes(rows, keys, percentiles=False).select(*keys, "avg_delay_hours", "completed_count", "on_time_rate", "shipment_count")


def port_daily_activity(events: DataFrame) -> DataFrame:
    return events.groupBy("port_code", F.to_date("event_timestamp").alias("event_date")).agg(
        F.count("*").alias("event_count"), F.count_if(F.col("event_type") == "DELAYED").alias("delayed_event_count"), F.sum("delay_minutes").alias("total_delay_minutes")
    )


def shipments_enriched(shipments: DataFrame, ports: DataFrame) -> DataFrame:
    """Curated shipments with both ports' columns."""
    out, ports = shipments.drop("_source_row"), small(ports)
    for side in ("origin", "destination"):
        names = {"port_name": f"{side}_port_name", "country": f"{side}_country", "region": f"{side}_region", "avg_congestion_score": f"{side}_congestion"}
        side_ports = ports.select(F.col("port_code").alias("_code"), *(F.col(c).alias(a) for c, a in names.items()))
        out = out.join(side_ports, F.col(f"{side}_port") == F.col("_code")).drop("_code")
    return out


def single_route_stats(shipments: DataFrame, origin: str, destination: str, date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    """One row, with zero counts for a route without shipments; bounds are on planned_departure, the last day included."""
    rows = shipments.where((F.col("origin_port") == origin) & (F.col("destination_port") == destination))
    rows = _between(rows, "planned_departure", date_from, date_to)
    return _outcomes(rows, []).select(*_STATS, "on_time_count")


def _between(rows: DataFrame, column: str, date_from: date | None, date_to: date | None) -> DataFrame:
    if date_from is not None:
        rows = rows.where(F.col(column) >= F.lit(str(date_from)).cast("timestamp_ntz"))
    if date_to is not None:
        rows = rows.where(F.col(column) < F.lit(str(date_to)).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    return rows


def period_coverage(shipments: DataFrame) -> DataFrame:
    """Quarters, and whether the data cover each from its first day to its end."""
    bounds = shipments.agg(F.date_trunc("day", F.min("planned_departure")).cast("timestamp_ntz").alias("lo"), F.max("planned_departure").alias("hi"))
    start = F.min(F.date_trunc("quarter", "planned_departure").cast("timestamp_ntz"))
    quarters = shipments.select("*", _quarter()[2]).groupBy("period").agg(start.alias("quarter_start"), F.count("*").alias("shipments"), F.count("actual_delay_hours").alias("completed"))
    complete = (F.col("quarter_start") >= F.col("lo")) & (F.col("quarter_start") + F.expr("INTERVAL 3 MONTH") <= F.col("hi"))
    return quarters.join(F.broadcast(bounds)).select("period", "quarter_start", "shipments", "completed", complete.alias("complete"))


def route_rankings(shipments: DataFrame, metric: str = "avg_delay_hours", descending: bool = True, period: str | None = None, min_completed: int = 3, limit: int = 10) -> DataFrame:
    """The top routes by a metric of all data or one quarter; ties by completed_count, then route_key."""
    if metric not in D.RANKING_METRICS:
        raise ValueError(f"unsupported ranking metric: {metric}")
    rows = route_quarterly_stats(shipments).where(F.col("period") == period) if period else _outcomes(shipments, _ROUTE, percentiles=False)
    order = F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last()
    columns = ["route_key", "origin_port", "destination_port", "shipment_count", "completed_count", "avg_delay_hours", "on_time_rate"]
    return rows.where(F.col("completed_count") >= min_completed).select(columns).orderBy(order, F.col("completed_count").desc(), "route_key").limit(limit)


def latest_complete_period(shipments: DataFrame) -> str | None:
    row = period_coverage(shipments).where("complete").orderBy(F.col("quarter_start").desc()).head()
    return row.period if row else None


def _check_page(filters: dict[str, str] | None, date_from: date | None, date_to: date | None, sort: str, page: int, page_size: int) -> None:
    if sort not in D.SORT_COLUMNS:
        raise ValueError(f"unsupported sort column: {sort}")
    if not 1 <= page_size <= 100 or page < 1:
        raise ValueError("page must be 1 or more and page_size from 1 to 100")
    if date_from is not None and date_to is not None and date_from > date_to:
        raise ValueError("date_from is after date_to")
    if unknown := set(filters or {}) - {"origin_port", "destination_port", "status", "cargo_type"}:
        raise ValueError(f"unsupported filters: {sorted(unknown)}")


def _filtered(shipments: DataFrame, filters: dict[str, str] | None) -> DataFrame:
    for c, v in (filters or {}).items():
        shipments = shipments.where(F.col(c) == v)
    return shipments


def shipment_page(shipments: DataFrame, filters: dict[str, str] | None = None, date_from: date | None = None, date_to: date | None = None, sort: str = "booking_date", descending: bool = True, page: int = 1, page_size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(the page's rows, one row with total); equality filters and a range of planned_departure, the last day included."""
    _check_page(filters, date_from, date_to, sort, page, page_size)
    rows = _between(_filtered(shipments, filters), "planned_departure", date_from, date_to)
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return rows.orderBy(order, "shipment_id").offset((page - 1) * page_size).limit(page_size), rows.agg(F.count("*").alias("total"))


def next_page(shipments: DataFrame, cursor: tuple | None, filters: dict[str, str] | None = None, date_from: date | None = None, date_to: date | None = None, sort: str = "booking_date", descending: bool = True, page_size: int = 20) -> DataFrame:
    """The page after a cursor, (sort value, shipment_id) of the last row of the page before it; the first page without one.

    Work doesn't depend on how far on the page is: page_size rows of each partition come together, never those before it.
    """
    _check_page(filters, date_from, date_to, sort, 1, page_size)
    rows = _between(_filtered(shipments, filters), "planned_departure", date_from, date_to)
    if cursor is not None:
        rows = rows.where(after([(sort, descending), ("shipment_id", False)], cursor))
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return rows.orderBy(order, "shipment_id").limit(page_size)


def shipment_lookup(shipments: DataFrame, ports: DataFrame, shipment_id: str) -> DataFrame:
    """A curated shipment with its ports, by its id in any case and padding."""
    return shipments_enriched(shipments.where(F.col("shipment_id") == shipment_id.strip().upper()), ports).limit(1)


def shipment_details(shipments: DataFrame, ports: DataFrame) -> DataFrame:
    """Curated shipments with each port as a struct: port_code, port_name, country, region, avg_congestion_score."""
    out, ports = shipments.drop("_source_row"), small(ports)
    fields = ("port_code", "port_name", "country", "region", "avg_congestion_score")
    for side in ("origin", "destination"):
        port = ports.select(F.col("port_code").alias("_code"), F.struct(*fields).alias(side))
        out = out.join(port, F.col(f"{side}_port") == F.col("_code")).drop("_code")
    return out


def known_ports(ports: DataFrame, codes: list[str]) -> DataFrame:
    return ports.where(F.col("port_code").isin(codes)).select("port_code")
