"""Calls over a published run, as plain Python: what an HTTP layer or an assistant's tools would expose."""

from __future__ import annotations

import json
import re
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import serving as S
from ..operators import training as M
from ..sources.files import current, current_run
from ..sources.layout import SortedTable

#: Characters that a tool's result may have (longer lists lose their last items), and rows that tools may ask for.
RESULT_CHARS, PAGE_ROWS, RANKED_ROWS = 6000, 25, 20
_PERIOD = re.compile(r"\d{4}-Q[1-4]")


class NotFound(LookupError):
    """What was asked for does not exist."""


class Api:
    """Look-ups, pages, route statistics and rankings over the current run; rows come back as dicts, rounded to 4 places."""

    def __init__(self, spark: SparkSession, root: str | Path, model: str | None = None) -> None:
        """model is the folder of a saved model, for predictions."""
        self.spark, self.root, self.model_folder = spark, root, model
        self._model: M.Trained | None = None
        self.tables = current(spark, root)
        self.shipments, self.port_table = self.tables["curated.shipments"], self.tables["curated.ports"]
        self.by_id = SortedTable(spark, f"{root}/run={current_run(spark, root)}/curated.shipments")

    @staticmethod
    def _rows(df: DataFrame) -> list[dict]:
        return [{k: round(v, 4) if isinstance(v, float) else v for k, v in r.asDict(recursive=True).items()} for r in df.collect()]

    def health(self) -> dict:
        """Whether the run, its tables and the model can be read; without a model's folder that part is left out."""
        parts: dict[str, str] = {}
        out: dict = {}
        try:
            out["run_id"], out["shipments"] = current_run(self.spark, self.root), self.shipments.count()
            parts["warehouse"] = "ok"
        except Exception as error:
            parts["warehouse"] = f"down: {str(error).splitlines()[0]}"
        if self.model_folder is not None:
            try:
                parts["model"] = f"ok: {self._trained().metadata['version']}"
            except M.ModelError as error:
                parts["model"] = f"down: {error}"
        return {"status": "ok" if all(v.startswith("ok") for v in parts.values()) else "down", "parts": parts} | out

    def _trained(self) -> M.Trained:
        if self.model_folder is None:
            raise NotFound("no model")
        if self._model is None:
            self._model = M.load(self.spark, self.model_folder)
        return self._model

    def predict_delay(self, shipment_id: str | None = None, booking: dict | None = None) -> dict:
        """A prediction for a shipment by its id, or for a booking: exactly one of the two."""
        if (shipment_id is None) == (booking is None):
            raise ValueError("give shipment_id or booking")
        if shipment_id is not None:
            rows = self.by_id.where_key(shipment_id.strip().upper()).limit(1)
            if rows.isEmpty():
                raise NotFound(f"shipment {shipment_id}")
        else:
            rows = self._booking(booking)
        return self._rows(M.predict(self._trained(), rows, self.port_table))[0]

    def _booking(self, booking: dict) -> DataFrame:
        """A booking as a table of one row; its ports must be known and differ, its times be in order."""
        if extra := sorted(set(booking) - set(M.L.BOOKING_INPUTS)):
            raise ValueError(f"unknown fields {extra}")
        values = dict.fromkeys(M.L.BOOKING_INPUTS) | booking
        times = {c: datetime.fromisoformat(v) if isinstance(v := values[c], str) else v for c in ("booking_date", "planned_departure", "planned_arrival")}
        if any(t is None for t in times.values()) or not times["booking_date"] <= times["planned_departure"] < times["planned_arrival"]:
            raise ValueError("booking_date, planned_departure and planned_arrival must be given, in this order")
        values |= times | {c: str(values[c] or "").strip().upper() for c in ("origin_port", "destination_port")}
        self._route(values["origin_port"], values["destination_port"])
        row = tuple(float(values[c]) if c == "weight_tons" and values[c] is not None else values[c] for c in M.L.BOOKING_INPUTS)
        return self.spark.createDataFrame([row], "origin_port string, destination_port string, cargo_type string, container_count int, weight_tons double, booking_date timestamp_ntz, planned_departure timestamp_ntz, planned_arrival timestamp_ntz")

    def _route(self, origin: str, destination: str) -> None:
        """Both ports are known and differ."""
        if origin == destination:
            raise ValueError("origin and destination are the same")
        known = {r.port_code for r in S.known_ports(self.port_table, [origin, destination]).collect()}
        if missing := sorted({origin, destination} - known):
            raise NotFound(f"ports {missing}")

    def ports(self) -> list[dict]:
        return self._rows(self.port_table.drop("dq_flags").orderBy("port_code"))

    def shipment(self, shipment_id: str) -> dict:
        rows = self._rows(S.shipment_lookup(self.by_id.where_key(shipment_id.strip().upper()), self.port_table, shipment_id))
        if not rows:
            raise NotFound(f"shipment {shipment_id}")
        return rows[0]

    def list_shipments(self, page: int = 1, page_size: int = 20, **options) -> dict:
        rows, total = S.shipment_page(self.shipments, page=page, page_size=page_size, **options)
        n = total.head().total
        return {"items": self._rows(rows), "total": n, "total_pages": -(-n // page_size), "page": page}

    def route_stats(self, origin: str, destination: str, date_from: date | None = None, date_to: date | None = None) -> dict:
        origin, destination = origin.strip().upper(), destination.strip().upper()
        self._route(origin, destination)
        return self._rows(S.single_route_stats(self.shipments, origin, destination, date_from, date_to))[0]

    def rankings(self, metric: str = "avg_delay_hours", order: str = "desc", period: str = "latest", min_completed: int = 3, limit: int = 10) -> dict:
        """period: latest (the last complete quarter), all, or a quarter such as 2025-Q3."""
        if period not in ("latest", "all") and not _PERIOD.fullmatch(period):
            raise ValueError(f"period must be latest, all or a quarter such as 2025-Q3, not {period}")
        chosen = S.latest_complete_period(self.shipments) if period == "latest" else None if period == "all" else period
        rows = self._rows(S.route_rankings(self.shipments, metric, order == "desc", chosen, min_completed, limit))
        coverage = {r.period: r.complete for r in S.period_coverage(self.shipments).collect()} if chosen else {}
        if period not in ("latest", "all") and chosen not in coverage:
            raise NotFound(f"no shipments in {chosen}")
        notes = [f"{chosen} is not complete"] if chosen and not coverage.get(chosen, False) else []
        return {"period": chosen or "all", "items": [r | {"rank": i + 1} for i, r in enumerate(rows)], "notes": notes}


TOOLS = {
    "query_shipments": ("list_shipments", {"page", "page_size", "filters", "sort", "descending", "date_from", "date_to"}),
    "get_route_stats": ("route_stats", {"origin", "destination", "date_from", "date_to"}),
    "rank_routes": ("rankings", {"metric", "order", "period", "min_completed", "limit"}),
    "predict_delay": ("predict_delay", {"shipment_id", "booking"}),
}
#: The most rows that a tool's argument may ask for.
LIMITS = {"page_size": PAGE_ROWS, "limit": RANKED_ROWS}


def run_tool(api: Api, name: str, arguments: dict, number: int) -> dict:
    """A tool's result with a source id (on success alone), cut to RESULT_CHARS by leaving out last items."""
    if name not in TOOLS:
        return {"error": f"unknown tool {name}"}
    method, allowed = TOOLS[name]
    if extra := sorted(set(arguments) - allowed):
        return {"error": f"unknown arguments {extra}"}
    for c, most in LIMITS.items():
        if c in arguments and not 1 <= arguments[c] <= most:
            return {"error": f"{c} must be from 1 to {most}"}
    try:
        result = getattr(api, method)(**arguments)
    except (ValueError, LookupError, TypeError, M.ModelError) as error:
        return {"error": str(error)}
    text = lambda: json.dumps(result, default=str)
    while len(text()) > RESULT_CHARS and isinstance(result, dict) and result.get("items"):
        result = result | {"items": result["items"][:-1], "truncated": True}
    return {"source_id": f"S{number}", "result": result}


def filter_report(report: dict, severity: str | None = None, dataset: str | None = None, only_failed: bool = False) -> dict:
    """A check report's results by severity and dataset; the summary stays that of all."""
    checks = [c for c in report["checks"] if severity in (None, c["severity"]) and dataset in (None, c["dataset"]) and (not only_failed or c["status"] != "pass")]
    return {"summary": report["summary"], "checks": checks}


def markdown_report(report: dict) -> str:
    """A check report as a Markdown table."""
    lines = ["| check | severity | action | rows | share | status |", "|---|---|---|---|---|---|"]
    lines += [f"| {c['check_name']} | {c['severity']} | {c['action']} | {c['rows_affected']} | {c['pct_affected']}% | {c['status']} |" for c in report["checks"]]
    return "\n".join(lines)


def turn_costs(log: DataFrame) -> DataFrame:
    """Tokens, cost and calls by turn of an interaction log."""
    return log.groupBy("turn_id").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"))


def system_context(api: Api) -> str:
    """What an assistant is told of the data: the known ports and the quarters that shipments cover."""
    ports = ", ".join(f"{p['port_code']} ({p['port_name']}, {p['region']})" for p in api.ports())
    quarters = ", ".join(r.period + ("" if r.complete else " (not complete)") for r in S.period_coverage(api.shipments).orderBy("quarter_start").collect())
    return f"Ports: {ports}.\nQuarters: {quarters}."
