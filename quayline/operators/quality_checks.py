"""Data-quality checks on raw text rows: a registry of masks, evaluated together in one scan of each table.

A check is a dataset, a severity, an action, a mask, a weight and a frame. Masks of one row look at raw rows as they are
read, so no row's texts are shuffled; texts are parsed once, and look-ups and medians are columns that prepare() adds.
Checks of copies and versions have a frame of ids: each with its rows _n and the different ones among them, _versions,
told apart by a digest. The order of events is that of single rows; that check has a frame of its own too. Blank means
null or white space only.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import domain as D
from ..functions.columns import content_key, is_blank, lax_double, mapped, norm_code, seconds_between, strict_timestamp, truth
from ..sources.scratch import kept
from .curation import Raw, small
from .quantiles import counted_values, percentiles, percentiles_of

#: Samples of keys in a result; a route's shipments from which on its median counts, and how far off it a transit may be.
SAMPLES, OUTLIER_ROWS, OUTLIER_SHARE = 10, 5, 0.5


@dataclass(frozen=True)
class Check:
    """mask tells which rows are hit, weight how many raw rows one of them stands for; frame is where it is looked for."""

    name: str
    dataset: str
    severity: str
    action: str
    mask: Callable[[], Column]
    weight: Callable[[], Column]
    frame: str


CHECKS: dict[str, Check] = {}
KEYS = {"shipments": "shipment_id", "ports": "port_code", "port_events": "event_id"}


def _each_copy() -> Column:
    return F.col("_n")


def check(name: str, severity: str, action: str, weight: Callable[[], Column] = _each_copy, frame: str | None = None) -> Callable[[Callable[[], Column]], Callable[[], Column]]:
    """Registers a mask under dataset.name; a name can be taken once."""

    def put(mask: Callable[[], Column]) -> Callable[[], Column]:
        if name in CHECKS:
            raise ValueError(f"check {name} is registered twice")
        dataset = name.split(".")[0]
        CHECKS[name] = Check(name, dataset, severity, action, mask, weight, frame or dataset)
        return mask

    return put


def _ts(name: str) -> Column:
    return F.col(f"_t_{name}")


def _number(name: str) -> Column:
    return F.col(f"_d_{name}")


def _late_hours() -> Column:
    return seconds_between(_ts("planned_arrival"), _ts("actual_arrival")) / F.lit(3600.0)


def _alias() -> Column:
    return mapped(norm_code("status"), D.STATUS_ALIASES)


def _no_status() -> Column:
    return is_blank("status") | (norm_code("status") == "N/A")


_TIMES = ("booking_date", "planned_departure", "actual_departure", "planned_arrival", "actual_arrival")
_any = lambda *c: reduce(lambda a, b: a | b, map(truth, c))
_not = lambda c: ~truth(c)

_SIMPLE: list[tuple[str, str, str, Callable[[], Column]]] = [
    ("shipments.exact_duplicate_rows", "critical", "drop", lambda: F.col("_n") > F.col("_versions")),
    ("shipments.conflicting_duplicate_ids", "critical", "quarantine", lambda: F.col("_versions") > 1),
    ("shipments.invalid_id_format", "critical", "quarantine", lambda: _any(*(_not(F.col(c).rlike(f"^{p}$")) for c, p in (("shipment_id", "SHP-[0-9]{5}"), ("customer_id", "CUST-[0-9]{4}"), ("vessel_id", "VSL-[0-9]{4}"))))),
    ("shipments.unknown_port_code", "critical", "quarantine", lambda: ~F.col("_known_origin") | ~F.col("_known_destination")),
    ("shipments.same_origin_destination", "warning", "quarantine", lambda: F.trim("origin_port") == F.trim("destination_port")),
    ("shipments.unparseable_timestamp", "critical", "quarantine", lambda: _any(*(~is_blank(c) & _ts(c).isNull() for c in _TIMES))),
    ("shipments.missing_planned_timestamp", "critical", "quarantine", lambda: _any(*(is_blank(c) for c in ("booking_date", "planned_departure", "planned_arrival")))),
    ("shipments.planned_arrival_not_after_departure", "critical", "quarantine", lambda: _any(_ts("planned_arrival") <= _ts("planned_departure"), _ts("planned_departure") < _ts("booking_date"))),
    ("shipments.actual_departure_before_booking", "critical", "fix", lambda: _ts("actual_departure") < _ts("booking_date")),
    ("shipments.actual_arrival_before_departure", "critical", "fix", lambda: _ts("actual_arrival") <= _ts("actual_departure")),
    ("shipments.planned_transit_outlier_for_route", "info", "none", lambda: (F.col("_route_rows") >= OUTLIER_ROWS) & (F.abs(F.col("_transit") - F.col("_route_median")) / F.nullif("_route_median", F.lit(0.0)) > OUTLIER_SHARE)),
    ("shipments.status_non_canonical", "warning", "fix", lambda: ~_no_status() & ~F.col("status").isin(*D.STATUSES)),
    ("shipments.status_missing_or_placeholder", "warning", "fix", _no_status),
    ("shipments.status_actuals_mismatch", "warning", "flag", lambda: F.when(truth(_alias() == "CANCELLED"), ~is_blank("actual_arrival")).otherwise(~_no_status() & is_blank("actual_arrival"))),
    ("shipments.status_delay_contradiction", "warning", "fix", lambda: _any((_alias() == "DELAYED") & (_late_hours() <= D.ON_TIME_HOURS), (_alias() == "DELIVERED") & (_late_hours() > D.ON_TIME_HOURS))),
    ("shipments.cargo_type_non_canonical", "warning", "fix", lambda: ~is_blank("cargo_type") & ~F.col("cargo_type").isin(*D.CARGO_TYPES)),
    ("shipments.cargo_type_missing", "warning", "flag", lambda: is_blank("cargo_type")),
    ("shipments.weight_missing", "warning", "flag", lambda: is_blank("weight_tons")),
    ("shipments.weight_non_positive", "warning", "fix", lambda: _number("weight_tons") <= 0),
    ("shipments.container_count_zero", "warning", "fix", lambda: _number("container_count") <= 0),
    ("shipments.container_count_outlier", "warning", "fix", lambda: _number("container_count") > D.MAX_CONTAINERS),
    ("ports.missing_field", "warning", "fix", lambda: _any(*(is_blank(c) for c in D.PORT_COLUMNS[1:]))),
    ("ports.duplicate_port_code", "critical", "drop", lambda: F.col("_later")),
    ("ports.congestion_out_of_range", "warning", "flag", lambda: ~is_blank("avg_congestion_score") & _not(_number("avg_congestion_score").between(0, 1))),
    ("ports.invalid_timezone_format", "warning", "flag", lambda: ~is_blank("timezone") & _not(F.col("timezone").rlike("^UTC[+-][0-9]{1,2}(:[0-9]{2})?$"))),
    ("port_events.exact_duplicate_rows", "warning", "drop", lambda: F.col("_n") > F.col("_versions")),
    ("port_events.duplicate_event_id", "warning", "fix", lambda: F.col("_versions") > 1),
    ("port_events.missing_event_type", "warning", "quarantine", lambda: is_blank("event_type")),
    ("port_events.invalid_event_type", "warning", "quarantine", lambda: ~is_blank("event_type") & ~F.col("event_type").isin(*D.EVENT_TYPES)),
    ("port_events.sentinel_vessel_id", "warning", "quarantine", lambda: F.col("vessel_id").isin(*D.SENTINEL_VESSELS)),
    ("port_events.unknown_port_code", "warning", "quarantine", lambda: ~F.col("_known_port")),
    ("port_events.unparseable_timestamp", "critical", "quarantine", lambda: _ts("event_timestamp").isNull()),
    ("port_events.out_of_order", "info", "none", lambda: _ts("event_timestamp") < F.col("_before")),
    ("port_events.delay_out_of_range", "warning", "flag", lambda: _not(_number("delay_minutes").between(0, D.MAX_EVENT_DELAY))),
    ("port_events.delayed_event_without_delay", "info", "flag", lambda: (F.col("event_type") == "DELAYED") & (_number("delay_minutes") == 0)),
    ("port_events.notes_contradict_delay", "info", "none", lambda: (F.col("notes") == "Normal operations") & (_number("delay_minutes") > 0)),
    ("port_events.missing_notes", "info", "none", lambda: is_blank("notes")),
]
_copies = lambda: F.col("_n") - F.col("_versions")
_WEIGHTS = {"shipments.exact_duplicate_rows": _copies, "port_events.exact_duplicate_rows": _copies, "shipments.conflicting_duplicate_ids": lambda: F.col("_versions")}
_FRAMES = {"shipments.exact_duplicate_rows": "shipment_ids", "shipments.conflicting_duplicate_ids": "shipment_ids", "port_events.exact_duplicate_rows": "event_ids", "port_events.duplicate_event_id": "event_ids", "port_events.out_of_order": "event_order"}
for _name, _severity, _action, _mask in _SIMPLE:
    check(_name, _severity, _action, _WEIGHTS.get(_name, _each_copy), _FRAMES.get(_name))(_mask)


def with_previous(rows: DataFrame, value: Column, alias: str, bucket: int = 100_000) -> DataFrame:
    """rows with the value of the row before in _row_number order.

    Rows are dealt by ranges of _row_number; the last value of each range is handed to the next non-empty one through
    a frame of one row a range, so that no task holds the whole table.
    """
    part = F.floor(F.col("_row_number") / bucket)
    rows = rows.withColumn("_v", value).withColumn("_part", part)
    last = rows.groupBy("_part").agg(F.max_by("_v", "_row_number").alias("_carry"))
    last = last.select("_part", F.lag("_carry").over(Window.orderBy("_part")).alias("_carry"))
    inner = Window.partitionBy("_part").orderBy("_row_number")
    first = F.row_number().over(inner) == 1
    return rows.select("*", F.lag("_v").over(inner).alias("_lag"), first.alias("_first")).join(last, "_part").withColumn(alias, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))).drop("_v", "_part", "_carry", "_lag", "_first")


def _texts(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns of single rows (_n), null and empty being equal."""
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns), F.lit(1).cast("bigint").alias("_n"))


def _ids(texts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each id, the first of columns, with _n, its rows, and _versions, the different ones among them."""
    versions = texts.groupBy(columns[0], content_key(*columns[1:]).alias("_content")).agg(F.sum("_n").alias("_n"))
    return versions.groupBy(columns[0]).agg(F.sum("_n").alias("_n"), F.count("*").alias("_versions"))


def _parsed(texts: DataFrame, times: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    return texts.select("*", *(strict_timestamp(c).alias(f"_t_{c}") for c in times), *(lax_double(c).alias(f"_d_{c}") for c in numbers))


def prepare(raw: Raw) -> dict[str, DataFrame]:
    """The frames that checks look at: rows with what masks need, ids with their versions, and events in their order."""
    codes = small(raw.ports.select(F.trim("port_code").alias("_code")).distinct())

    def known(rows: DataFrame, column: str, alias: str) -> DataFrame:
        return rows.join(codes, F.trim(column) == F.col("_code"), "left").withColumn(alias, F.col("_code").isNotNull()).drop("_code")

    texts, event_texts = _texts(raw.shipments, D.SHIPMENT_COLUMNS), _texts(raw.port_events, D.EVENT_COLUMNS)
    s = _parsed(texts, _TIMES, ("weight_tons", "container_count"))
    s = s.withColumn("_transit", seconds_between(_ts("planned_departure"), _ts("planned_arrival")) / F.lit(86400.0))
    s = known(known(s, "origin_port", "_known_origin"), "destination_port", "_known_destination")
    route = ["origin_port", "destination_port"]
    transits = kept(counted_values(s, route, "_transit", "_n"))
    medians = percentiles_of(transits, route, [0.5]).select(*route, F.col("q")[0].alias("_route_median"))
    medians = medians.join(transits.groupBy(*route).agg(F.sum("n").alias("_route_rows")), route)
    s = s.join(small(medians), route, "left")
    code = Window.partitionBy(F.coalesce("port_code", F.lit(""))).orderBy("_row_number")
    p = raw.ports.select("*", F.lit(1).cast("bigint").alias("_n"), (F.row_number().over(code) > 1).alias("_later"), lax_double("avg_congestion_score").alias("_d_avg_congestion_score"))
    e = known(_parsed(event_texts, ("event_timestamp",), ("delay_minutes",)), "port_code", "_known_port")
    order = raw.port_events.select("event_id", "_row_number", F.lit(1).cast("bigint").alias("_n"), strict_timestamp("event_timestamp").alias("_t_event_timestamp"))
    return {"shipments": s, "shipment_ids": _ids(texts, D.SHIPMENT_COLUMNS), "ports": p, "port_events": e, "event_ids": _ids(event_texts, D.EVENT_COLUMNS), "event_order": with_previous(order, _ts("event_timestamp"), "_before")}


def _hits(c: Check) -> Column:
    return F.coalesce(F.sum(F.when(truth(c.mask()), c.weight())), F.lit(0)).cast("bigint")


def mask_counts(raw: Raw) -> DataFrame:
    """check, rows_total, rows_affected of every check; one aggregation for each frame. A check without a frame is an error."""
    parts, frames = [], prepare(raw)
    if lost := [c.name for c in CHECKS.values() if c.frame not in frames]:
        raise ValueError(f"no frame for {', '.join(lost)}")
    for name, rows in frames.items():
        own = [c for c in CHECKS.values() if c.frame == name]
        counts = rows.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("_all"), *(_hits(c).alias(f"c{i}") for i, c in enumerate(own)))
        each = F.explode(F.array(*(F.struct(F.lit(c.name).alias("check"), F.col("_all").alias("rows_total"), F.col(f"c{i}").alias("rows_affected")) for i, c in enumerate(own))))
        parts.append(counts.select(each.alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)


def samples(raw: Raw, name: str) -> DataFrame:
    """The first SAMPLES distinct keys, in text order, that a check hits."""
    c = CHECKS[name]
    return prepare(raw)[c.frame].where(truth(c.mask())).select(F.col(KEYS[c.dataset]).alias("sample_key")).distinct().orderBy("sample_key").limit(SAMPLES)


def _all_samples(frames: dict[str, DataFrame], names: list[str]) -> dict[str, list[str]]:
    """Sample keys of many checks: one pass of each frame; at most SAMPLES keys a check come to the driver."""
    out: dict[str, list[str]] = {n: [] for n in names}
    for frame, rows in frames.items():
        own = [CHECKS[n] for n in names if CHECKS[n].frame == frame]
        if own:
            hit = F.explode(F.array_compact(F.array(*(F.when(truth(c.mask()), F.lit(c.name)) for c in own)))).alias("check")
            keys = rows.select(hit, F.coalesce(F.col(KEYS[own[0].dataset]), F.lit("")).alias("key")).distinct()
            first = F.row_number().over(Window.partitionBy("check").orderBy("key"))
            for r in keys.withColumn("_r", first).where(F.col("_r") <= SAMPLES).orderBy("check", "key").collect():
                out[r.check].append(r.key)
    return out


def report(raw: Raw, sources: dict[str, str] | None = None) -> dict:
    """Results of all checks with sample keys, a summary, and how long it took; sources names the inputs' fingerprints.

    A check that can't run is an error and stops no other, whether its mask fails or what its frame needs.
    """
    began, results, found, error_of = time.monotonic(), [], {}, {}
    try:
        frames = prepare(raw)
        found = {r.check: (r.rows_total, r.rows_affected) for r in mask_counts(raw).collect()}
    except Exception:  # one bad check fails the fused scan: then each runs alone
        for c in CHECKS.values():
            try:
                r = prepare(raw)[c.frame].agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), _hits(c).alias("k")).head()
                found[c.name] = (r.n, r.k)
            except Exception as error:
                error_of[c.name] = str(error).splitlines()[0]
    failed = [n for n, (_, k) in found.items() if k]
    try:
        keys = _all_samples(frames if not error_of else prepare(raw), failed)
    except Exception:  # the same for samples
        keys = {}
    for c in CHECKS.values():
        n, k = found.get(c.name, (0, 0))
        status = "error" if c.name in error_of else "fail" if k else "pass"
        results.append({"check_name": c.name, "dataset": c.dataset, "severity": c.severity, "action": c.action, "rows_total": n, "rows_affected": k, "pct_affected": round(100.0 * k / n, 3) if n else 0.0, "status": status, "error": error_of.get(c.name), "sample_keys": keys.get(c.name, [])})
    tally = {s: sum(r["status"] == s for r in results) for s in ("pass", "fail", "error")}
    return {"checks": results, "summary": tally | {"total": len(results), "critical_failures": sum(r["status"] == "fail" and r["severity"] == "critical" for r in results)}, "sources": sources or {}, "seconds": round(time.monotonic() - began, 3)}


def baseline(report: dict) -> dict[str, int]:
    """Rows hit by each check that could run: what later reports are held against."""
    return {c["check_name"]: c["rows_affected"] for c in sorted(report["checks"], key=lambda c: c["check_name"]) if c["status"] != "error"}


def gate(report: dict, base: dict[str, int], tolerance_percent: float = 10.0) -> list[str]:
    """What got worse: checks that can't run, new ones that hit, and those that hit more than the tolerance allows."""
    out = []
    for c in report["checks"]:
        name, now, before = c["check_name"], c["rows_affected"], base.get(c["check_name"], 0)
        if c["status"] == "error":
            out.append(f"{name}: {c['error']}")
        elif now > before * (1 + tolerance_percent / 100):
            out.append(f"{name}: {now} rows after {before}")
    return out


def regressions(current: DataFrame, baseline: DataFrame, tolerance_percent: float = 10.0) -> DataFrame:
    """check, rows_affected, baseline_rows of checks that got worse: new ones that hit, or more than the tolerance allows."""
    joined = current.join(baseline.select("check", F.col("rows_affected").alias("baseline_rows")), "check", "left")
    limit = F.coalesce("baseline_rows", F.lit(0)) * F.lit(1 + tolerance_percent / 100)
    return joined.where(F.col("rows_affected") > limit).select("check", "rows_affected", "baseline_rows")


#: The share of values that must parse for a type to be inferred, and distinct values up to which the top ones are told.
PARSED, FEW, TOP = 0.95, 30, 5


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: rows, blanks, distinct, numeric_share, min, median, max, inferred_type, unparseable, first_time, last_time.

    A column is empty, numeric or timestamp if PARSED of its non-blank values are, else string; unparseable counts the rest.
    min, median and max are those of values that are numbers. One aggregation for all columns, and one selection of ranks
    for all medians.
    """
    out, numbers = [], []
    for c in columns:
        text = F.when(~is_blank(c), F.trim(F.col(c)))
        v, t = lax_double(text), strict_timestamp(text)
        numbers.append(F.struct(F.lit(c).alias("column"), v.alias("v")))
        out.append(
            F.struct(
                F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(text.isNull()).alias("blanks"), F.count_distinct(text).alias("distinct"),
                (F.count(v) / F.nullif(F.count(text), F.lit(0))).alias("numeric_share"), F.min(v).alias("min"), F.max(v).alias("max"),
                F.count(text).alias("said"), F.count(v).alias("numbers"), F.count(t).alias("times"), F.min(t).alias("first_time"), F.max(t).alias("last_time"),
            ).alias(f"p_{c}")
        )
    one = rows.agg(*out)
    x = one.select(F.explode(F.array(*(f"`{n}`" for n in one.columns))).alias("x")).select("x.*")
    long = rows.select(F.explode(F.array(*numbers)).alias("x")).select("x.*")
    x = x.join(F.broadcast(percentiles(long, ["column"], "v", [0.5]).select("column", F.col("q")[0].alias("median"))), "column", "left")
    enough = lambda n: F.col(n) >= PARSED * F.col("said")
    kind = F.when(F.col("said") == 0, "empty").when(enough("numbers"), "numeric").when(enough("times"), "timestamp").otherwise("string")
    lost = F.when(kind == "numeric", F.col("said") - F.col("numbers")).when(kind == "timestamp", F.col("said") - F.col("times"))
    return x.select("column", "rows", "blanks", "distinct", "numeric_share", "min", "median", "max", kind.alias("inferred_type"), lost.alias("unparseable"), "first_time", "last_time")


def dataset_profile(rows: DataFrame, columns: list[str]) -> dict:
    """Rows, columns, exact copies, and the profiles, with the top values of columns of few distinct ones."""
    total, once = rows.count(), rows.select(*columns).distinct().count()
    profiles = {r.column: r.asDict() for r in column_profile(rows, columns).collect()}
    few = [c for c, p in profiles.items() if 0 < p["distinct"] <= FEW]
    if few:
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.when(~is_blank(c), F.trim(F.col(c))).alias("value")) for c in few)))
        found = rows.select(each.alias("x")).where("x.value IS NOT NULL").groupBy("x.column", "x.value").agg(F.count("*").alias("n")).collect()  # FEW values a column
        for c in few:
            own = sorted((r for r in found if r.column == c), key=lambda r: (-r.n, r.value))[:TOP]
            profiles[c]["top_values"] = {r.value: r.n for r in own}
    return {"rows": total, "columns": len(columns), "exact_duplicate_rows": total - once, "column_profiles": profiles}


def top_values(rows: DataFrame, column: str, n: int = TOP) -> DataFrame:
    """The most frequent values, ties in text order, with their share."""
    total = rows.agg(F.count("*").alias("_n"))
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows")).join(F.broadcast(total)).select("value", "rows", (F.col("rows") / F.col("_n")).alias("share")).orderBy(F.desc("rows"), "value").limit(n)
