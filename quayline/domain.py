"""The shipment domain: fixed values, column lists and thresholds.

Fixed values (they must equal what users of the data expect): statuses and their aliases, cargo and event types,
bounds, placeholder vessels, known country corrections.
"""

from __future__ import annotations

ON_TIME_HOURS = 24.0
STATUS_ALIASES = {"DELIVERED": "DELIVERED", "COMPLETED": "DELIVERED", "COMPLETE": "DELIVERED", "DELAYED": "DELAYED", "CANCELLED": "CANCELLED", "CANCELED": "CANCELLED"}
STATUSES = ("CANCELLED", "DELAYED", "DELIVERED")
UNKNOWN_STATUS = "UNKNOWN"
CARGO_TYPES = ("Apparel", "Automotive Parts", "Chemicals", "Consumer Goods", "Electronics", "Food & Beverage", "Furniture", "Machinery", "Pharmaceuticals", "Raw Materials")
UNKNOWN_CARGO = "Unknown"
EVENT_TYPES = ("ARRIVAL", "BERTHED", "CUSTOMS_CLEARED", "DELAYED", "DEPARTURE", "INSPECTION", "LOADING_COMPLETE")
MAX_CONTAINERS = 100
MAX_EVENT_DELAY = 1440
SENTINEL_VESSELS = ("VSL-0000", "VSL-9999")
COUNTRY_FIXES = {"BEANR": "Belgium"}
MAX_QUARANTINE_PERCENT = 10.0

SHIPMENT_COLUMNS = ("shipment_id", "customer_id", "origin_port", "destination_port", "vessel_id", "booking_date", "planned_departure", "actual_departure", "planned_arrival", "actual_arrival", "container_count", "cargo_type", "weight_tons", "status")
CURATED_SHIPMENT_COLUMNS = ("shipment_id", "customer_id", "origin_port", "destination_port", "route_key", "vessel_id", "booking_date", "planned_departure", "actual_departure", "planned_arrival", "actual_arrival", "container_count", "cargo_type", "weight_tons", "status", "status_raw", "actual_delay_hours", "on_time_flag", "transit_days_planned", "transit_days_actual", "booking_lead_days", "dq_flags", "_source_row")
EVENT_COLUMNS = ("event_id", "event_timestamp", "port_code", "vessel_id", "event_type", "delay_minutes", "notes")
PORT_COLUMNS = ("port_code", "port_name", "country", "region", "timezone", "avg_congestion_score")
RANKING_METRICS = ("avg_delay_hours", "on_time_rate", "shipment_count", "completed_count")
SORT_COLUMNS = ("booking_date", "planned_departure", "planned_arrival", "actual_delay_hours", "shipment_id")
