"""Small raw tables: a plain row, and what a case changes in it."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import SparkSession

from quayline import domain as D
from quayline.operators.curation import Raw

START = datetime(2031, 3, 4, 6, 30)
PORTS = [
    ("AAONE", "First Harbour", "Aland", "NORTH", "UTC+2", "0.31"),
    ("BBTWO", "Second Quay", "Borea", "SOUTH", "UTC-5", "0.62"),
    ("CCTRI", "Third Pier", "Cadia", "SOUTH", "UTC+0", "0.05"),
    ("BEANR", "Fourth Dock", "", "NORTH", "UTC+1", "0.44"),
]


def at(days: float, form: str = "%Y-%m-%d %H:%M:%S") -> str:
    """A moment so many days after the booking of the plain shipment."""
    return (START + timedelta(days=days)).strftime(form)


#: Leaves after 5 days, takes 20, comes 12 hours late: delivered in time.
SHIPMENT = {
    "shipment_id": "SHP-70001", "customer_id": "CUST-2200", "origin_port": "AAONE", "destination_port": "BBTWO", "vessel_id": "VSL-0420", "booking_date": at(0),
    "planned_departure": at(5), "actual_departure": at(5.25), "planned_arrival": at(25), "actual_arrival": at(25.5), "container_count": "40", "cargo_type": "Furniture", "weight_tons": "77.25", "status": "DELIVERED",
}
EVENT = {"event_id": "EVT-510001", "event_timestamp": at(1), "port_code": "BBTWO", "vessel_id": "VSL-0420", "event_type": "BERTHED", "delay_minutes": "15", "notes": "Tug late"}


def frame(spark: SparkSession, rows: list[dict | tuple], columns: tuple[str, ...], blank_null: bool = True):
    values = [tuple(r[c] for c in columns) if isinstance(r, dict) else r for r in rows]
    values = [(*(None if v == "" and blank_null else v for v in row), i + 1) for i, row in enumerate(values)]
    return spark.createDataFrame(values, ", ".join(f"{c} string" for c in columns) + ", _row_number bigint")


def raw(spark: SparkSession, shipments: list[dict] | None = None, events: list[dict] | None = None, ports: list[tuple] | None = None, blank_null: bool = True) -> Raw:
    return Raw(
        frame(spark, [SHIPMENT | s for s in shipments] if shipments is not None else [SHIPMENT], D.SHIPMENT_COLUMNS, blank_null),
        frame(spark, [EVENT | e for e in events] if events is not None else [EVENT], D.EVENT_COLUMNS, blank_null),
        frame(spark, ports if ports is not None else PORTS, D.PORT_COLUMNS, blank_null),
    )
