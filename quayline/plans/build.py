"""The whole build: raw files to curated, quarantined and served tables, checked by the contract, then published."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from .. import domain as D
from ..operators import serving as S
from ..operators.contract import assert_valid
from ..operators.curation import Curated, curate, staged_to
from ..operators.fingerprint import combined, fingerprint
from ..sources import store
from ..sources.files import new_run, publish, read_raw
from ..sources.layout import write_sorted


#: What the files of a run's tables are sorted by, so that look-ups open few of them.
SORTED_BY = {"curated.ports": "port_code", "curated.shipments": "shipment_id", "curated.port_events": "event_key", "quarantine.shipments": "shipment_id", "quarantine.port_events": "event_key"}


def build(spark: SparkSession, folder: str | Path, root: str | Path, max_quarantine_percent: float = D.MAX_QUARANTINE_PERCENT) -> dict:
    """Builds and publishes a run; raises ContractError and leaves nothing behind if a rule is violated.

    Staged tables are written once and read for all that comes of them. A run holds the curated, quarantined and served
    tables, and tables about itself: meta.run, meta.validation and meta.fingerprints.
    """
    raw, sums = read_raw(spark, folder)
    run, place = new_run(root)
    try:
        c = curate(raw, staged_to(f"{place}/_staged"))
        tables = {"curated.ports": c.ports, "curated.shipments": c.shipments, "curated.port_events": c.port_events, "quarantine.shipments": c.quarantined_shipments, "quarantine.port_events": c.quarantined_events}
        back = {}
        for name, df in tables.items():
            write_sorted(df, f"{place}/{name}", [SORTED_BY[name]], bloom=(SORTED_BY[name],))
            back[name] = spark.read.parquet(f"{place}/{name}")
        done = Curated(back["curated.ports"], back["curated.shipments"], back["quarantine.shipments"], back["curated.port_events"], back["quarantine.port_events"])
        rules = assert_valid(raw, done, max_quarantine_percent)
        views = {"serving.route_stats": S.route_stats(done.shipments), "serving.route_quarterly_stats": S.route_quarterly_stats(done.shipments), "serving.port_daily_activity": S.port_daily_activity(done.port_events), "serving.shipments_enriched": S.shipments_enriched(done.shipments, done.ports)}
        prints = {n: fingerprint(df) for n, df in back.items()}
        counts = {n: df.count() for n, df in back.items()}
        meta = {"run_id": run, "row_counts": counts, "source_files": sums, "contract": rules, "fingerprints": prints, "content_fingerprint": combined(prints)}
        views |= {
            "meta.run": spark.createDataFrame([(run, datetime.now(UTC).replace(tzinfo=None), meta["content_fingerprint"])], "run_id string, built_at timestamp_ntz, content_fingerprint string"),
            "meta.validation": spark.createDataFrame(sorted(rules.items()), "rule string, violations bigint"),
            "meta.fingerprints": spark.createDataFrame([(n, counts[n], p) for n, p in prints.items()], "relation string, rows bigint, fingerprint string"),
        }
        for name, df in views.items():
            df.write.mode("overwrite").parquet(f"{place}/{name}")
        store.remove(spark, f"{place}/_staged")
        store.write_json(spark, meta, f"{root}/run={run}.json")
        publish(spark, root, run)
        return meta
    except BaseException:
        store.remove(spark, place)
        raise


def summary(meta: dict) -> str:
    """A build's counts, rules and fingerprint as Markdown."""
    lines = [f"# Run {meta['run_id']}", "", "| Table | Rows |", "|---|---|", *(f"| {n} | {k} |" for n, k in sorted(meta["row_counts"].items()))]
    lines += ["", f"{len(meta['contract'])} rules hold." if not any(meta["contract"].values()) else "Rules are violated.", f"Content {meta['content_fingerprint']}."]
    return "\n".join(lines)
