"""From raw text rows to curated and quarantined ones.

Versions of an id and exact copies among them come together in one shuffle and one sort; texts are parsed once after it. A staged table is written once (see staged_to) or computed for each reader.

Ports are a dimension: they are broadcast only up to PORT_ROWS counted rows and joined by a shuffle beyond that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import domain as D
from ..functions.columns import blank_to_null, first_match, flags, lax_double, lax_int, mapped, match_key, minutes_between, norm_code, strict_timestamp, truth

PORT_ROWS = 100_000

#: Rows that a task sorts or adds up.
PARTITION_ROWS = 200_000


@dataclass(frozen=True)
class Raw:
    """Raw tables: text columns and _row_number, a number that orders the rows of a file and is unique in it."""

    shipments: DataFrame
    port_events: DataFrame
    ports: DataFrame


@dataclass(frozen=True)
class Curated:
    ports: DataFrame
    shipments: DataFrame
    quarantined_shipments: DataFrame
    port_events: DataFrame
    quarantined_events: DataFrame


def small(df: DataFrame, most: int = PORT_ROWS) -> DataFrame:
    """df, broadcast if it has at most that many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def first_rows(df: DataFrame, keys: list[str | Column], *order: str | Column) -> DataFrame:
    """The first row of each key; equal keys include nulls. Rows dealt by some of the keys already are not shuffled again."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def without_copies(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """columns and _row_number, each combination once with its least number; nulls are equal here."""
    return rows.groupBy(*columns).agg(F.min("_row_number").alias("_row_number"))


def curate_ports(ports: DataFrame) -> DataFrame:
    code = norm_code("port_code")
    fix, country = mapped(code, D.COUNTRY_FIXES), blank_to_null("country")
    rows = first_rows(ports.withColumn("_code", code), ["_code"], "_row_number")
    return rows.select(
        code.alias("port_code"),
        F.trim("port_name").alias("port_name"),
        F.coalesce(country, fix).alias("country"),
        F.trim("region").alias("region"),
        F.trim("timezone").alias("timezone"),
        lax_double("avg_congestion_score").alias("avg_congestion_score"),
        flags((country.isNull() & fix.isNotNull(), "country_filled_from_fix_list")).alias("dq_flags"),
    )


#: How each text of a shipment is read; the names with _raw are those that quarantine tables show.
_READ: dict[str, tuple[str, Callable[[str], Column]]] = {
    **{c: (c, F.trim) for c in ("shipment_id", "customer_id", "vessel_id")},
    **{c: (c, norm_code) for c in ("origin_port", "destination_port")},
    **{c: (c, strict_timestamp) for c in ("booking_date", "planned_departure", "planned_arrival")},
    **{f"{c}_raw": (c, strict_timestamp) for c in ("actual_departure", "actual_arrival")},
    "container_count_raw": ("container_count", lax_int),
    "weight_tons_raw": ("weight_tons", lax_double),
    "cargo_type_raw": ("cargo_type", F.col),
    "status_raw": ("status", F.col),
}


def _empty_fields() -> Column:
    """How many of a shipment's fields, but for its id and ports, say nothing."""
    said = [blank_to_null(c) if c in ("cargo_type", "status") else F.col(c) for c in D.SHIPMENT_COLUMNS if c not in ("shipment_id", "origin_port", "destination_port")]
    return F.size(F.filter(F.array(*said), lambda x: x.isNull()))


def with_known(rows: DataFrame, ports: DataFrame, **columns: str) -> DataFrame:
    """rows with a boolean for each named column of codes: whether a port has that code."""
    codes = small(ports.select("port_code"))
    for name, c in columns.items():
        rows = rows.join(codes.select(F.col("port_code").alias("_code")), F.col(c) == F.col("_code"), "left").withColumn(name, F.col("_code").isNotNull()).drop("_code")
    return rows


def dealt(rows: DataFrame, number: int | None, *by: str) -> DataFrame:
    """rows dealt by columns: to as many partitions as that number of rows needs, or as the cluster's settings say.

    A task then holds PARTITION_ROWS rows however many there are, so it doesn't spill or grow as tables do.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(*by) if number is None else rows.repartition(max(-(-number // PARTITION_ROWS), min(cores, number // 1000), 1), *by)


def stage_shipments(shipments: DataFrame, ports: DataFrame, number: int | None = None) -> DataFrame:
    """Typed rows without exact copies, with quarantine_reason: the first that holds, or null.

    Of several versions of an id the one with the fewest empty fields survives, of equal ones the first. number is how
    many rows there are, if known.
    """
    rank = F.struct(_empty_fields().alias("empty"), F.col("_row_number").alias("row"))
    once = first_rows(dealt(shipments.withColumn("_id", F.trim("shipment_id")), number, "_id"), ["_id", *D.SHIPMENT_COLUMNS], "_row_number")
    best = once.select("*", F.min(rank).over(Window.partitionBy("_id")).alias("_best"), rank.alias("_rank"))
    rows = best.select(*(read(c).alias(name) for name, (c, read) in _READ.items()), "_row_number", "_rank", "_best")
    rows = with_known(rows, ports, _from="origin_port", _to="destination_port")
    booked, leaves, arrives = F.col("booking_date"), F.col("planned_departure"), F.col("planned_arrival")
    reason = first_match(
        (F.col("_rank") > F.col("_best"), "conflicting_duplicate_id"),
        (~(F.col("_from") & F.col("_to")), "unknown_port_code"),
        (F.col("origin_port") == F.col("destination_port"), "same_origin_destination"),
        (booked.isNull() | leaves.isNull() | arrives.isNull(), "missing_or_invalid_planned_timestamp"),
        ((arrives <= leaves) | (leaves < booked), "invalid_planned_sequence"),
    )
    return rows.select(*_READ, "_row_number", reason.alias("quarantine_reason"))


def rederived_status(alias: Column, arrived: Column, delay: Column) -> Column:
    """CANCELLED only without an arrival; DELAYED or DELIVERED by the delay; else UNKNOWN."""
    open_ = ~alias.eqNullSafe(F.lit("CANCELLED"))
    return F.when((alias == "CANCELLED") & arrived.isNull(), "CANCELLED").when(arrived.isNotNull() & open_, F.when(delay > D.ON_TIME_HOURS, "DELAYED").otherwise("DELIVERED")).otherwise(D.UNKNOWN_STATUS)


def _hours(start: str, end: str, minutes: float = 60.0) -> Column:
    return minutes_between(start, end) / F.lit(minutes)


def curate_shipments(staged: DataFrame) -> DataFrame:
    """The rows without a reason, repaired, with derived columns and flags.

    A departure before the booking is taken out; an arrival not after the departure takes out both.
    """
    left, arrived = F.col("actual_departure_raw"), F.col("actual_arrival_raw")
    rows = staged.where("quarantine_reason IS NULL").withColumns({
        "_too_early": truth(left < F.col("booking_date")),
        "_backwards": truth(arrived <= left),
        "_alias": mapped(norm_code("status_raw"), D.STATUS_ALIASES),
        "_cargo": mapped(match_key("cargo_type_raw"), {c.lower(): c for c in D.CARGO_TYPES}),
    })
    too_early, backwards, alias, goods = (F.col(c) for c in ("_too_early", "_backwards", "_alias", "_cargo"))
    rows = rows.withColumns({"actual_departure": F.when(~too_early & ~backwards, left), "actual_arrival": F.when(~backwards, arrived)})
    rows = rows.withColumn("actual_delay_hours", _hours("planned_arrival", "actual_arrival"))
    count, weight, cargo, delay, there = (F.col(c) for c in ("container_count_raw", "weight_tons_raw", "cargo_type_raw", "actual_delay_hours", "actual_arrival"))
    new = {
        "route_key": F.concat("origin_port", F.lit(" → "), "destination_port"),
        "container_count": F.when(count.between(1, D.MAX_CONTAINERS), count),
        "cargo_type": F.coalesce(goods, F.lit(D.UNKNOWN_CARGO)),
        "weight_tons": F.when(weight > 0, weight),
        "status": rederived_status(alias, there, delay),
        "on_time_flag": delay <= D.ON_TIME_HOURS,
        "transit_days_planned": _hours("planned_departure", "planned_arrival", 1440.0),
        "transit_days_actual": _hours("actual_departure", "actual_arrival", 1440.0),
        "booking_lead_days": _hours("booking_date", "planned_departure", 1440.0),
        "dq_flags": flags(
            (too_early, "actual_departure_before_booking"),
            (backwards, "actual_arrival_before_departure"),
            first_match((blank_to_null(cargo).isNull(), "cargo_type_missing"), (goods.isNull(), "cargo_type_unrecognised"), (cargo != goods, "cargo_type_normalised")),
            first_match((weight.isNull(), "weight_missing"), (weight <= 0, "weight_non_positive")),
            first_match((count.isNull(), "container_count_missing"), (count <= 0, "container_count_zero"), (count > D.MAX_CONTAINERS, "container_count_outlier")),
            first_match((alias.isNull(), "status_missing_or_unmapped"), (F.col("status_raw") != alias, "status_normalised")),
            (there.isNull() & ~truth(alias == "CANCELLED"), "no_observed_outcome"),
        ),
        "_source_row": F.col("_row_number"),
    }
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in D.CURATED_SHIPMENT_COLUMNS))


def stage_events(events: DataFrame, ports: DataFrame) -> DataFrame:
    """Typed events without exact copies; event_key is a hash of the content, since event ids collide."""
    content = [F.col(c) for c in D.EVENT_COLUMNS[:-1]] + [F.coalesce("notes", F.lit(""))]
    rows = without_copies(events, D.EVENT_COLUMNS).select(
        F.md5(F.concat_ws("|", *content)).alias("event_key"),
        F.trim("event_id").alias("event_id"),
        strict_timestamp("event_timestamp").alias("event_timestamp"),
        norm_code("port_code").alias("port_code"),
        F.trim("vessel_id").alias("vessel_id"),
        F.nullif(norm_code("event_type"), F.lit("")).alias("event_type"),
        lax_int("delay_minutes").alias("delay_minutes"),
        blank_to_null("notes").alias("notes"),
        "_row_number",
    )
    rows = rows.withColumn("event_id_collision", F.count("*").over(Window.partitionBy("event_id")) > 1)
    reason = first_match(
        (F.col("event_timestamp").isNull(), "unparseable_timestamp"),
        (F.col("event_type").isNull(), "missing_event_type"),
        (~F.col("event_type").isin(*D.EVENT_TYPES), "invalid_event_type"),
        (F.col("vessel_id").isin(*D.SENTINEL_VESSELS), "sentinel_vessel_id"),
        (~F.col("_known"), "unknown_port_code"),
    )
    return with_known(rows, ports, _known="port_code").withColumn("quarantine_reason", reason).drop("_known")


def curate_events(staged: DataFrame) -> DataFrame:
    return staged.where("quarantine_reason IS NULL").select(
        "event_key", "event_id", "event_timestamp", "port_code", "vessel_id", "event_type", "delay_minutes", "notes",
        flags((F.col("event_id_collision"), "event_id_collision"), ((F.col("event_type") == "DELAYED") & (F.col("delay_minutes") == 0), "delayed_event_without_delay")).alias("dq_flags"),
        F.col("_row_number").alias("_source_row"),
    )


def staged_to(folder: str) -> Callable[[DataFrame, str], DataFrame]:
    """A way to stage: frames are written below a folder that the cluster shares and read back, so they are computed once."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    return keep


def curate(raw: Raw, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Curated:
    """All curated and quarantined tables; keep is what is done to the staged frames, which feed two outputs each."""
    ports = curate_ports(raw.ports)
    return from_staged(ports, keep(stage_shipments(raw.shipments, ports), "shipments"), keep(stage_events(raw.port_events, ports), "port_events"))


def from_staged(ports: DataFrame, shipments: DataFrame, events: DataFrame) -> Curated:
    """All tables from curated ports and staged shipments and events."""
    bad = "quarantine_reason IS NOT NULL"
    return Curated(ports, curate_shipments(shipments), shipments.where(bad), curate_events(events), events.where(bad))


def lineage(curated: DataFrame, raw: DataFrame) -> DataFrame:
    """curated rows with raw, the row that each was made of."""
    source = raw.select(F.col("_row_number").alias("_source_row"), F.struct(*raw.columns).alias("raw"))
    return curated.join(source, "_source_row")
