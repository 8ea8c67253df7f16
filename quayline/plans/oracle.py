"""The SQL that queries are held against, derived from the written rules, in another form than the operators'.

Rules are rows: what breaks one, and what a flag stands for, are single queries put together by UNION; the first reason
and the order of flags come from numbers beside them. Fixed lists are tables that are joined in.
"""

from __future__ import annotations

from .. import domain as D
from ..sources import fixtures as X


def _values(*rows: tuple) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


def _moment(c: str) -> str:
    return f"TRY_STRPTIME(trim({c}), '%Y-%m-%d %H:%M:%S')"


def _minutes(a: str, b: str, per: int) -> str:
    """Whole minutes from a to b, each cut to its minute, over per."""
    return f"(epoch(date_trunc('minute', {b})) - epoch(date_trunc('minute', {a}))) / (60 * CAST({per} AS DOUBLE))"


def _rules(*rules: tuple[int, str, str], name: str) -> str:
    """One row for each rule that a row of its relation breaks: n, the rule's number, its name."""
    return " UNION ALL ".join(f"SELECT n, {i} AS no, '{label}' AS {name} FROM {source}" for i, label, source in rules)


PORTS = f"""rp AS ({X.PORTS_SQL}),
ports AS (SELECT upper(trim(p.port_code)) AS port_code, trim(port_name) AS port_name, CASE WHEN trim(p.country) <> '' THEN trim(p.country) ELSE fix.country END AS country, trim(region) AS region,
  trim(timezone) AS timezone, TRY_CAST(avg_congestion_score AS DOUBLE) AS avg_congestion_score FROM rp p LEFT JOIN {_values(*D.COUNTRY_FIXES.items())} fix(code, country) ON fix.code = upper(trim(p.port_code)))"""

_CLOCKS = ("booking_date", "planned_departure", "actual_departure", "planned_arrival", "actual_arrival")
_SAID = tuple(c for c in D.SHIPMENT_COLUMNS if c not in ("shipment_id", "origin_port", "destination_port"))
_NO_PORT = lambda c: f"NOT EXISTS (FROM ports WHERE port_code = upper(trim({c})))"

SHIPMENTS = f"""{PORTS}, rs AS ({X.SHIPMENTS_SQL}),
once AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY line, shipment_id) AS n FROM (SELECT {", ".join(D.SHIPMENT_COLUMNS)}, min(_row_number) AS line FROM rs GROUP BY ALL)),
clocks AS (UNPIVOT (SELECT n, {", ".join(_CLOCKS)} FROM once) ON {", ".join(_CLOCKS)} INTO NAME what VALUE said),
times AS MATERIALIZED (SELECT n, {", ".join(f"max({_moment('said')}) FILTER (what = '{c}') AS t_{c}" for c in _CLOCKS)} FROM clocks GROUP BY n),
fields AS (SELECT n, unnest([{", ".join(f"'{c}'" for c in _SAID)}]) AS what, unnest([{", ".join(_SAID)}]) AS said FROM once),
gaps AS MATERIALIZED (SELECT n, trim(any_value(shipment_id)) AS id, count(*) FILTER (said IS NULL OR (what IN ('cargo_type', 'status') AND trim(said) = '')) AS missing FROM fields JOIN once USING (n) GROUP BY n),
outdone AS (SELECT n FROM gaps a WHERE EXISTS (FROM gaps b WHERE b.id IS NOT DISTINCT FROM a.id AND (b.missing < a.missing OR (b.missing = a.missing AND b.n < a.n)))),
broken AS ({_rules(
    (1, 'conflicting_duplicate_id', 'outdone'),
    (2, 'unknown_port_code', f"once WHERE {_NO_PORT('origin_port')} OR {_NO_PORT('destination_port')}"),
    (3, 'same_origin_destination', 'once WHERE upper(trim(origin_port)) = upper(trim(destination_port))'),
    (4, 'missing_or_invalid_planned_timestamp', 'once LEFT JOIN times USING (n) WHERE t_booking_date IS NULL OR t_planned_departure IS NULL OR t_planned_arrival IS NULL'),
    (5, 'invalid_planned_sequence', 'times WHERE t_planned_arrival <= t_planned_departure OR t_planned_departure < t_booking_date'),
    name='reason')}),
verdicts AS MATERIALIZED (SELECT n, arg_min(reason, no) AS reason FROM broken GROUP BY n),
staged AS (SELECT trim(shipment_id) AS shipment_id, upper(trim(origin_port)) AS origin_port, upper(trim(destination_port)) AS destination_port, reason AS quarantine_reason, line AS _row_number FROM once LEFT JOIN verdicts USING (n)),
sound AS MATERIALIZED (SELECT once.*, times.* EXCLUDE (n), TRY_CAST(container_count AS INTEGER) AS boxes, TRY_CAST(weight_tons AS DOUBLE) AS tons, alias.means, goods.kind,
  CASE WHEN t_actual_departure < t_booking_date OR t_actual_arrival <= t_actual_departure THEN NULL ELSE t_actual_departure END AS went,
  CASE WHEN t_actual_arrival <= t_actual_departure THEN NULL ELSE t_actual_arrival END AS came
  FROM once ANTI JOIN verdicts USING (n) LEFT JOIN times USING (n) LEFT JOIN {_values(*D.STATUS_ALIASES.items())} alias(word, means) ON word = upper(trim(status))
  LEFT JOIN {_values(*((c,) for c in D.CARGO_TYPES))} goods(kind) ON lower(kind) = lower(trim(regexp_replace(cargo_type, '\\s+', ' ', 'g')))),
marks AS ({_rules(
    (1, 'actual_departure_before_booking', 'sound WHERE t_actual_departure < t_booking_date'),
    (2, 'actual_arrival_before_departure', 'sound WHERE t_actual_arrival <= t_actual_departure'),
    (3, 'cargo_type_missing', "sound WHERE coalesce(trim(cargo_type), '') = ''"),
    (3, 'cargo_type_unrecognised', "sound WHERE trim(cargo_type) <> '' AND kind IS NULL"),
    (3, 'cargo_type_normalised', 'sound WHERE cargo_type <> kind'),
    (4, 'weight_missing', 'sound WHERE tons IS NULL'),
    (4, 'weight_non_positive', 'sound WHERE tons <= 0'),
    (5, 'container_count_missing', 'sound WHERE boxes IS NULL'),
    (5, 'container_count_zero', 'sound WHERE boxes <= 0'),
    (5, 'container_count_outlier', f'sound WHERE boxes > {D.MAX_CONTAINERS}'),
    (6, 'status_missing_or_unmapped', 'sound WHERE means IS NULL'),
    (6, 'status_normalised', 'sound WHERE status <> means'),
    (7, 'no_observed_outcome', "sound WHERE came IS NULL AND coalesce(means, '') <> 'CANCELLED'"),
    name='mark')}),
marked AS (SELECT n, list(mark ORDER BY no) AS dq_flags FROM marks GROUP BY n),
curated AS MATERIALIZED (SELECT trim(shipment_id) AS shipment_id, trim(customer_id) AS customer_id, upper(trim(origin_port)) AS origin_port, upper(trim(destination_port)) AS destination_port,
  concat_ws(' → ', upper(trim(origin_port)), upper(trim(destination_port))) AS route_key, trim(vessel_id) AS vessel_id, t_booking_date AS booking_date, t_planned_departure AS planned_departure, went AS actual_departure,
  t_planned_arrival AS planned_arrival, came AS actual_arrival, CASE WHEN boxes > 0 AND boxes <= {D.MAX_CONTAINERS} THEN boxes END AS container_count, coalesce(kind, '{D.UNKNOWN_CARGO}') AS cargo_type, CASE WHEN tons > 0 THEN tons END AS weight_tons,
  CASE WHEN (coalesce(means, '') = 'CANCELLED') <> (came IS NULL) THEN '{D.UNKNOWN_STATUS}' WHEN came IS NULL THEN 'CANCELLED' WHEN late > {D.ON_TIME_HOURS} THEN 'DELAYED' ELSE 'DELIVERED' END AS status, status AS status_raw,
  late AS actual_delay_hours, late <= {D.ON_TIME_HOURS} AS on_time_flag, {_minutes('t_planned_departure', 't_planned_arrival', 1440)} AS transit_days_planned, {_minutes('went', 'came', 1440)} AS transit_days_actual,
  {_minutes('t_booking_date', 't_planned_departure', 1440)} AS booking_lead_days, coalesce(dq_flags, []) AS dq_flags, line AS _source_row
  FROM (SELECT *, {_minutes('t_planned_arrival', 'came', 60)} AS late FROM sound) LEFT JOIN marked USING (n))"""

EVENTS = f"""{PORTS}, re AS ({X.EVENTS_SQL}),
once_e AS MATERIALIZED (SELECT {", ".join(D.EVENT_COLUMNS)}, min(_row_number) AS n FROM re GROUP BY ALL),
shared_e AS (SELECT trim(event_id) AS id FROM once_e GROUP BY 1 HAVING count(*) > 1),
broken_e AS ({_rules(
    (1, 'unparseable_timestamp', f"once_e WHERE {_moment('event_timestamp')} IS NULL"),
    (2, 'missing_event_type', "once_e WHERE coalesce(trim(event_type), '') = ''"),
    (3, 'invalid_event_type', f"once_e ANTI JOIN {_values(*((t,) for t in D.EVENT_TYPES))} known(kind) ON kind = upper(trim(event_type)) WHERE trim(event_type) <> ''"),
    (4, 'sentinel_vessel_id', f"once_e SEMI JOIN {_values(*((v,) for v in D.SENTINEL_VESSELS))} unreal(ship) ON ship = trim(vessel_id)"),
    (5, 'unknown_port_code', f"once_e WHERE {_NO_PORT('once_e.port_code')}"),
    name='reason')}),
verdicts_e AS (SELECT n, arg_min(reason, no) AS reason FROM broken_e GROUP BY n),
staged_e AS MATERIALIZED (SELECT md5(concat_ws('|', event_id, event_timestamp, port_code, vessel_id, event_type, delay_minutes, coalesce(notes, ''))) AS event_key, trim(event_id) AS event_id, {_moment('event_timestamp')} AS event_timestamp,
  upper(trim(port_code)) AS port_code, trim(vessel_id) AS vessel_id, CASE WHEN trim(event_type) <> '' THEN upper(trim(event_type)) END AS event_type, TRY_CAST(delay_minutes AS INTEGER) AS delay_minutes,
  CASE WHEN trim(notes) <> '' THEN trim(notes) END AS notes, shared_e.id IS NOT NULL AS collides, n AS _row_number, reason AS quarantine_reason
  FROM once_e LEFT JOIN verdicts_e USING (n) LEFT JOIN shared_e ON shared_e.id = trim(event_id)),
curated_e AS (SELECT event_key, event_id, event_timestamp, port_code, vessel_id, event_type, delay_minutes, notes, _row_number AS _source_row,
  string_split(concat_ws('|', CASE WHEN collides THEN 'event_id_collision' END, CASE WHEN event_type = 'DELAYED' AND delay_minutes = 0 THEN 'delayed_event_without_delay' END), '|') AS dq_flags
  FROM staged_e WHERE quarantine_reason IS NULL)"""

BOTH = f"{SHIPMENTS}, {EVENTS.removeprefix(PORTS + ', ')}"

#: Statistics of a group of shipments.
STATS = """count(*) AS shipment_count, count(actual_delay_hours) AS completed_count, CAST(coalesce(sum(CAST(status = 'CANCELLED' AS INT)), 0) AS BIGINT) AS cancelled_count,
round(sum(actual_delay_hours) / nullif(count(actual_delay_hours), 0), 4) AS avg_delay_hours, round(quantile_cont(actual_delay_hours, [0.5, 0.9])[1], 4) AS median_delay_hours,
round(quantile_cont(actual_delay_hours, [0.5, 0.9])[2], 4) AS p90_delay_hours, sum(CAST(on_time_flag AS INT)) / nullif(count(on_time_flag), 0) AS on_time_rate,
arg_min(planned_departure, planned_departure) AS first_planned_departure, arg_max(planned_departure, planned_departure) AS last_planned_departure"""


def query(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


# ------------------------------------------------------------------------------------------------- checks of raw tables
_BLANK = lambda c: f"coalesce(trim({c}, ' \t\n\r\f\v'), '') = ''"
_NUMBER = lambda c: f"TRY_CAST(trim({c}) AS DOUBLE)"
_MEANS = f"(SELECT means FROM {_values(*D.STATUS_ALIASES.items())} v(word, means) WHERE word = upper(trim(status)))"
_LATE = f"date_diff('microsecond', {_moment('planned_arrival')}, {_moment('actual_arrival')}) / 3600e6"
_NO_STATUS = f"({_BLANK('status')} OR upper(trim(status)) = 'N/A')"
_IN = lambda c, values: f"{c} IN (" + ", ".join(f"'{v}'" for v in values) + ")"
_RAW_PORT = lambda c: f"trim({c}) NOT IN (SELECT trim(port_code) FROM rp)"
_ALIKE = lambda columns: "GROUP BY " + ", ".join(f"coalesce({c}, '')" for c in columns)


def _hit(table: str, *any_of: str) -> str:
    return f"SELECT count(*) FROM {table} WHERE " + " OR ".join(f"({c})" for c in any_of)


def _surplus(table: str, columns: tuple[str, ...]) -> str:
    return f"SELECT coalesce(sum(k - 1), 0) FROM (SELECT count(*) AS k FROM {table} {_ALIKE(columns)})"


def _versions(table: str, columns: tuple[str, ...], key: str) -> str:
    return f"SELECT coalesce(sum(k), 0) FROM (SELECT count(*) AS k FROM (SELECT coalesce(any_value({key}), '') AS id FROM {table} {_ALIKE(columns)}) GROUP BY id HAVING count(*) > 1)"


#: Rows that each check hits, as a query of its own.
CHECKS = {
    "shipments.exact_duplicate_rows": _surplus("rs", D.SHIPMENT_COLUMNS),
    "shipments.conflicting_duplicate_ids": _versions("rs", D.SHIPMENT_COLUMNS, "shipment_id"),
    "shipments.invalid_id_format": _hit("rs", *(f"NOT coalesce(regexp_full_match({c}, '{p}'), false)" for c, p in (("shipment_id", "SHP-[0-9]{5}"), ("customer_id", "CUST-[0-9]{4}"), ("vessel_id", "VSL-[0-9]{4}")))),
    "shipments.unknown_port_code": _hit("rs", _RAW_PORT("origin_port"), _RAW_PORT("destination_port")),
    "shipments.same_origin_destination": _hit("rs", "trim(origin_port) = trim(destination_port)"),
    "shipments.unparseable_timestamp": _hit("rs", *(f"NOT ({_BLANK(c)}) AND {_moment(c)} IS NULL" for c in _CLOCKS)),
    "shipments.missing_planned_timestamp": _hit("rs", *(_BLANK(c) for c in ("booking_date", "planned_departure", "planned_arrival"))),
    "shipments.planned_arrival_not_after_departure": _hit("rs", f"{_moment('planned_arrival')} <= {_moment('planned_departure')}", f"{_moment('planned_departure')} < {_moment('booking_date')}"),
    "shipments.actual_departure_before_booking": _hit("rs", f"{_moment('actual_departure')} < {_moment('booking_date')}"),
    "shipments.actual_arrival_before_departure": _hit("rs", f"{_moment('actual_arrival')} <= {_moment('actual_departure')}"),
    "shipments.planned_transit_outlier_for_route": f"""SELECT count(*) FROM (SELECT days, median(days) OVER route AS usual, count(days) OVER route AS k FROM (SELECT origin_port, destination_port, date_diff('microsecond', {_moment('planned_departure')}, {_moment('planned_arrival')}) / 86400e6 AS days FROM rs)
      WINDOW route AS (PARTITION BY origin_port, destination_port)) WHERE k >= 5 AND abs(days - usual) > 0.5 * abs(usual) AND usual > 0""",
    "shipments.status_non_canonical": _hit("rs", f"NOT {_NO_STATUS} AND NOT {_IN('status', D.STATUSES)}"),
    "shipments.status_missing_or_placeholder": _hit("rs", _NO_STATUS),
    "shipments.status_actuals_mismatch": _hit("rs", f"{_MEANS} = 'CANCELLED' AND NOT ({_BLANK('actual_arrival')})", f"{_MEANS} IS DISTINCT FROM 'CANCELLED' AND NOT {_NO_STATUS} AND {_BLANK('actual_arrival')}"),
    "shipments.status_delay_contradiction": _hit("rs", f"{_MEANS} = 'DELAYED' AND {_LATE} <= 24", f"{_MEANS} = 'DELIVERED' AND {_LATE} > 24"),
    "shipments.cargo_type_non_canonical": _hit("rs", f"NOT ({_BLANK('cargo_type')}) AND NOT {_IN('cargo_type', D.CARGO_TYPES)}"),
    "shipments.cargo_type_missing": _hit("rs", _BLANK("cargo_type")),
    "shipments.weight_missing": _hit("rs", _BLANK("weight_tons")),
    "shipments.weight_non_positive": _hit("rs", f"{_NUMBER('weight_tons')} <= 0"),
    "shipments.container_count_zero": _hit("rs", f"{_NUMBER('container_count')} <= 0"),
    "shipments.container_count_outlier": _hit("rs", f"{_NUMBER('container_count')} > {D.MAX_CONTAINERS}"),
    "ports.missing_field": _hit("rp", *(_BLANK(c) for c in D.PORT_COLUMNS[1:])),
    "ports.duplicate_port_code": _surplus("rp", ("port_code",)),
    "ports.congestion_out_of_range": _hit("rp", f"NOT ({_BLANK('avg_congestion_score')}) AND NOT coalesce({_NUMBER('avg_congestion_score')} BETWEEN 0 AND 1, false)"),
    "ports.invalid_timezone_format": _hit("rp", f"NOT ({_BLANK('timezone')}) AND NOT regexp_full_match(timezone, 'UTC[+-][0-9]{{1,2}}(:[0-9]{{2}})?')"),
    "port_events.exact_duplicate_rows": _surplus("re", D.EVENT_COLUMNS),
    "port_events.duplicate_event_id": f"SELECT count(*) FROM re WHERE coalesce(event_id, '') IN (SELECT id FROM (SELECT coalesce(any_value(event_id), '') AS id FROM re {_ALIKE(D.EVENT_COLUMNS)}) GROUP BY id HAVING count(*) > 1)",
    "port_events.missing_event_type": _hit("re", _BLANK("event_type")),
    "port_events.invalid_event_type": _hit("re", f"NOT ({_BLANK('event_type')}) AND NOT {_IN('event_type', D.EVENT_TYPES)}"),
    "port_events.sentinel_vessel_id": _hit("re", _IN("vessel_id", D.SENTINEL_VESSELS)),
    "port_events.unknown_port_code": _hit("re", _RAW_PORT("port_code")),
    "port_events.unparseable_timestamp": _hit("re", f"{_moment('event_timestamp')} IS NULL"),
    "port_events.out_of_order": f"SELECT count(*) FROM (SELECT {_moment('event_timestamp')} AS t, lag({_moment('event_timestamp')}) OVER (ORDER BY _row_number) AS before FROM re) WHERE t < before",
    "port_events.delay_out_of_range": _hit("re", f"NOT coalesce({_NUMBER('delay_minutes')} BETWEEN 0 AND {D.MAX_EVENT_DELAY}, false)"),
    "port_events.delayed_event_without_delay": _hit("re", f"event_type = 'DELAYED' AND {_NUMBER('delay_minutes')} = 0"),
    "port_events.notes_contradict_delay": _hit("re", f"notes = 'Normal operations' AND {_NUMBER('delay_minutes')} > 0"),
    "port_events.missing_notes": _hit("re", _BLANK("notes")),
}
_TABLE = {"shipments": "rs", "ports": "rp", "port_events": "re"}
RAW = f"rs AS MATERIALIZED ({X.SHIPMENTS_SQL}), re AS MATERIALIZED ({X.EVENTS_SQL}), rp AS MATERIALIZED ({X.PORTS_SQL})"


def check_counts(names: tuple[str, ...] = tuple(CHECKS)) -> str:
    return query(RAW, " UNION ALL ".join(f"SELECT '{n}' AS \"check\", (SELECT count(*) FROM {_TABLE[n.split('.')[0]]}) AS rows_total, CAST(({CHECKS[n]}) AS BIGINT) AS rows_affected" for n in names))


# --------------------------------------------------------------------------------------------------------- the contract
_S, _FAR = "bad_s", D.ON_TIME_HOURS
#: Violations of each rule over the damaged tables of fixtures.damaged, as queries of their own.
RULES = {
    "pk_shipments_unique": f"SELECT (SELECT count(*) FROM {_S}) - (SELECT count(*) FROM (SELECT DISTINCT shipment_id FROM {_S} WHERE shipment_id IS NOT NULL)) + (SELECT count(*) FROM {_S} WHERE shipment_id IS NULL)",
    "pk_ports_unique": "SELECT sum(k - 1) FROM (SELECT count(*) AS k FROM bad_p GROUP BY port_code)",
    "pk_events_unique": "SELECT sum(k - 1) FROM (SELECT count(*) AS k FROM bad_e GROUP BY event_key)",
    "fk_shipment_ports": f"SELECT count(*) FROM {_S} WHERE origin_port NOT IN (SELECT port_code FROM bad_p) OR destination_port NOT IN (SELECT port_code FROM bad_p)",
    "fk_event_ports": "SELECT count(*) FROM bad_e WHERE port_code NOT IN (SELECT port_code FROM bad_p)",
    "required_fields_not_null": f"SELECT count(*) FROM {_S} WHERE booking_date IS NULL OR planned_departure IS NULL OR planned_arrival IS NULL OR route_key IS NULL OR status IS NULL OR cargo_type IS NULL",
    "ports_complete": "SELECT count(*) FROM bad_p WHERE country IS NULL OR region IS NULL OR avg_congestion_score IS NULL",
    "status_domain": f"SELECT count(*) FROM {_S} WHERE status NOT IN ('CANCELLED', 'DELAYED', 'DELIVERED', 'UNKNOWN')",
    "cargo_type_domain": f"SELECT count(*) FROM {_S} WHERE cargo_type <> 'Unknown' AND NOT {_IN('cargo_type', D.CARGO_TYPES)}",
    "container_count_range": f"SELECT count(*) FROM {_S} WHERE container_count < 1 OR container_count > {D.MAX_CONTAINERS}",
    "weight_positive": f"SELECT count(*) FROM {_S} WHERE weight_tons <= 0",
    "derived_delay_hours": f"SELECT count(*) FROM {_S} WHERE actual_delay_hours IS DISTINCT FROM {_minutes('planned_arrival', 'actual_arrival', 60)}",
    "derived_on_time_flag": f"SELECT count(*) FROM {_S} WHERE on_time_flag IS DISTINCT FROM (actual_delay_hours <= {_FAR})",
    "derived_route_key": f"SELECT count(*) FROM {_S} WHERE route_key <> origin_port || ' → ' || destination_port",
    "derived_transit_days": f"SELECT count(*) FROM {_S} WHERE transit_days_planned <= 0 OR transit_days_actual <= 0",
    "status_consistent_with_delay": f"SELECT count(*) FROM {_S} WHERE CASE status WHEN 'DELAYED' THEN coalesce(actual_delay_hours <= {_FAR}, true) WHEN 'DELIVERED' THEN coalesce(actual_delay_hours > {_FAR}, true) WHEN 'CANCELLED' THEN actual_delay_hours IS NOT NULL WHEN 'UNKNOWN' THEN actual_delay_hours IS NOT NULL ELSE false END",
    "reconcile_shipments": f"SELECT abs((SELECT count(*) FROM once) - (SELECT count(*) FROM {_S}) - (SELECT count(*) FROM verdicts))",
    "reconcile_port_events": "SELECT abs((SELECT count(*) FROM once_e) - (SELECT count(*) FROM bad_e) - (SELECT count(*) FROM verdicts_e))",
    "curated_not_empty": f"SELECT CASE WHEN EXISTS (FROM {_S}) THEN 0 ELSE 1 END",
    "quarantine_ratio": f"SELECT CASE WHEN q > {D.MAX_QUARANTINE_PERCENT / 100} * greatest(k, 1) THEN q ELSE 0 END FROM (SELECT (SELECT count(*) FROM verdicts) AS q, (SELECT count(*) FROM rs) AS k)",
}


def _damaged(table: str, changes: dict[str, str], lost: str, again: str) -> str:
    swaps = ", ".join(f"{e} AS {c}" for c, e in changes.items())
    return f"SELECT * REPLACE ({swaps}) FROM {table} WHERE NOT ({lost}) UNION ALL SELECT * REPLACE ({swaps}) FROM {table} WHERE {again}"


CONTRACT = query(f"{BOTH}, bad_s AS MATERIALIZED ({_damaged('curated', *X.DAMAGED_SHIPMENTS)}), bad_e AS MATERIALIZED ({_damaged('curated_e', *X.DAMAGED_EVENTS)}), bad_p AS MATERIALIZED ({_damaged('ports', *X.DAMAGED_PORTS)})", " UNION ALL ".join(f"SELECT '{n}' AS rule, CAST(({sql}) AS BIGINT) AS violations" for n, sql in RULES.items()))

# ---------------------------------------------------------------------------------------------------------- what was known
_PAST = lambda key: f"(SELECT avg(CAST(p.actual_delay_hours > 24 AS INT)) FROM done p WHERE p.{key} = s.{key} AND p.actual_arrival < s.booking_date)"
_MONTH = lambda what, side: f"(SELECT {what} FROM curated_e e WHERE e.port_code = s.{side}_port AND e.event_timestamp < s.booking_date AND e.event_timestamp >= s.booking_date - INTERVAL 30 DAY)"
HISTORY = query(
    f"{BOTH}, done AS MATERIALIZED (SELECT * FROM curated WHERE actual_delay_hours IS NOT NULL)",
    f"""SELECT shipment_id, {_PAST('vessel_id')} AS hist_vessel_late_rate, {_PAST('customer_id')} AS hist_customer_late_rate, {_PAST('route_key')} AS hist_route_late_rate, {_PAST('origin_port')} AS hist_origin_late_rate,
    {_MONTH('avg(e.delay_minutes)', 'origin')} AS hist_origin_event_delay_30d, {_MONTH("count(*) FILTER (e.event_type = 'DELAYED')", 'origin')} AS hist_origin_delayed_events_30d,
    {_MONTH('avg(e.delay_minutes)', 'destination')} AS hist_destination_event_delay_30d FROM done s""",
)
