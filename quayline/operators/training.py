"""Candidates for predicting late arrivals, how they are compared, and a chosen model that is saved, loaded and used.

Models are pipelines of pyspark.ml: they are fitted on, and score, whole tables. Fits are another library's algorithms
with the survey's settings, so no value parity of coefficients or of boosted trees is claimed.
"""

from __future__ import annotations

import json
import statistics
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import drift
from . import learning as L
from .categories import RareCategories

#: Rows that a category needs to count by its own name, the share of last rows that is kept for the test, and shuffles of labels.
MIN_ROWS, TEST_SHARE, PERMUTATIONS, SEED = 10, 0.15, 20, 42
METRICS = ("precision", "recall", "f1", "roc_auc", "average_precision", "brier")


@dataclass(frozen=True)
class Candidate:
    """A way to predict: its last stage (from the sum of weights), its numbers, whether it can be served, and how simple it is."""

    name: str
    model: Callable[[float], Estimator] | None
    numbers: tuple[str, ...] = L.NUMERIC
    servable: bool = True
    complexity: int = 1


def _logistic(total: float, c: float = 0.1) -> LogisticRegression:
    return LogisticRegression(labelCol="label", weightCol="_weight", regParam=1 / (c * max(total, 1.0)), elasticNetParam=0.0, standardization=False, maxIter=200)


def boosted(trees: int = 200) -> Callable[[float], GBTClassifier]:
    return lambda total: GBTClassifier(labelCol="label", weightCol="_weight", maxDepth=3, stepSize=0.05, maxIter=trees, seed=SEED)


CANDIDATES = {
    c.name: c
    for c in (
        Candidate("prior", None, complexity=0),
        Candidate("logistic", _logistic, complexity=1),
        Candidate("boosted", boosted(), complexity=2),
        Candidate("logistic_history", _logistic, L.NUMERIC + L.HISTORY, servable=False, complexity=3),
    )
}


@dataclass
class Trained:
    """A fitted pipeline and what is known of it; the prior has a rate and no pipeline."""

    name: str
    pipeline: PipelineModel | None
    metadata: dict = field(default_factory=dict)

    def scores(self, features: DataFrame) -> DataFrame:
        """features with p, the probability of a late arrival."""
        if self.pipeline is None:
            return features.withColumn("p", F.lit(float(self.metadata["rate"])))
        scored = self.pipeline.transform(features).withColumn("p", F.element_at(vector_to_array("probability"), 2))
        return scored.select(*features.columns, "p")


def fit(rows: DataFrame, candidate: Candidate) -> Trained:
    """A candidate fitted on rows (features and label); classes weigh the same, missing numbers are medians, rare categories are one."""
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(counts.values())
    if candidate.model is None:
        return Trained(candidate.name, None, {"rate": counts.get(1, 0) / total if total else 0.0})
    weight = {y: total / (len(counts) * n) for y, n in counts.items()}
    weighted = rows.withColumn("_weight", F.when(F.col("label") == 1, weight.get(1, 1.0)).otherwise(weight.get(0, 1.0)))
    known = rows.agg(*(F.count(c).alias(c) for c in candidate.numbers if c in rows.columns)).head().asDict()
    numbers = [c for c, n in known.items() if n]  # a column without any value tells nothing
    stages = [
        RareCategories(inputCols=list(L.CATEGORICAL), outputCols=[f"{c}_g" for c in L.CATEGORICAL], minRows=MIN_ROWS),
        StringIndexer(inputCols=[f"{c}_g" for c in L.CATEGORICAL], outputCols=[f"{c}_i" for c in L.CATEGORICAL], handleInvalid="keep", stringOrderType="frequencyDesc"),
        OneHotEncoder(inputCols=[f"{c}_i" for c in L.CATEGORICAL], outputCols=[f"{c}_v" for c in L.CATEGORICAL], handleInvalid="keep"),
        Imputer(strategy="median", inputCols=numbers, outputCols=[f"{c}_f" for c in numbers]),
        VectorAssembler(inputCols=[f"{c}_f" for c in numbers], outputCol="_numbers"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["_scaled", *(f"{c}_v" for c in L.CATEGORICAL)], outputCol="_features"),
        candidate.model(float(total)).setFeaturesCol("_features"),
    ]
    return Trained(candidate.name, Pipeline(stages=stages).fit(weighted))


def cross_validate(rows: DataFrame, candidate: Candidate, order: list[str] | None = None, n_folds: int = L.FOLDS, threshold: float = L.THRESHOLD) -> dict:
    """Metrics of each rolling fold, and their mean and population standard deviation."""
    folds = L.rolling_folds(rows, order or ["booking_date", "shipment_id"], n_folds).persist()
    try:
        found = []
        for k in range(n_folds):
            part = lambda name, k=k: folds.where((F.col("fold") == k) & (F.col("part") == name)).drop("fold", "part")
            scored = fit(part("train"), candidate).scores(part("test")).select(F.col("label").alias("y"), "p")
            found.append(L.classification_metrics(scored, threshold).head().asDict())
    finally:
        folds.unpersist()
    values = {m: [f[m] for f in found if f[m] is not None] for m in METRICS}
    return {"folds": found, "summary": {m: {"mean": round(statistics.fmean(v), 4) if v else None, "std": round(statistics.pstdev(v), 4) if v else None} for m, v in values.items()}}


def permutation_test(rows: DataFrame, candidate: Candidate, observed_auc: float, permutations: int = PERMUTATIONS, n_folds: int = L.FOLDS, seed: int = SEED) -> dict:
    """How often labels dealt at random do as well: p = (1 + cases at or above the observed AUC) / (1 + permutations).

    Labels are put in the order of a hash of the seed, the round and the row's id, and given to the rows in their order.
    Hashes are even, so their ranges, as many as rows need, are spans of about the same number of rows.
    """
    placed = L.with_position(rows, ["booking_date", "shipment_id"]).persist()
    n, aucs = placed.count(), []
    try:
        for i in range(permutations):
            dealt = L.with_random_position(placed.select("label", "shipment_id"), "shipment_id", n, seed, i)
            mixed = placed.drop("label").join(dealt.select("position", "label"), "position").drop("position")
            aucs.append(cross_validate(mixed, candidate, n_folds=n_folds)["summary"]["roc_auc"]["mean"])
    finally:
        placed.unpersist()
    return {"observed_auc": round(observed_auc, 4), "null_auc_mean": round(statistics.fmean(aucs), 4), "p_value": round((1 + sum(a >= observed_auc for a in aucs)) / (1 + len(aucs)), 4), "permutations": permutations}


def select_candidate(results: dict[str, dict], candidates: dict[str, Candidate] = CANDIDATES, metric: str = "average_precision") -> tuple[str, str]:
    """The servable candidate of the highest mean metric, but the simplest if the gain over it is within its standard deviation. The prior is no choice."""
    open_to = sorted((candidates[n] for n in results if candidates[n].servable and candidates[n].model), key=lambda c: c.complexity)
    value = lambda c, what="mean": results[c.name]["summary"][metric][what] or 0.0
    simple, best = open_to[0], max(open_to, key=value)
    gain = value(best) - value(simple)
    if best is not simple and gain <= value(simple, "std"):
        return simple.name, f"{best.name} gains {gain:.4f}, within one standard deviation"
    return best.name, f"highest mean {metric} {value(best):.4f}"


def train(rows: DataFrame, candidates: dict[str, Candidate] = CANDIDATES, permutations: int = PERMUTATIONS, rounds: int = 1000, n_folds: int = L.FOLDS) -> Trained:
    """Compares candidates on all rows but the last TEST_SHARE, fits the chosen one on them, and tests it on the last ones.

    rows are those of learning.training_rows. metadata has the candidate table, the choice, test metrics with an interval,
    thresholds, calibration, the permutation test, and the reference that drift is measured against.
    """
    placed = L.with_position(rows, ["booking_date", "shipment_id"])
    n = rows.count()
    split = int(n * (1 - TEST_SHARE))
    dev, test = placed.where(F.col("position") < split).drop("position").persist(), placed.where(F.col("position") >= split).drop("position")
    try:
        results = {name: cross_validate(dev, c, n_folds=n_folds) for name, c in candidates.items()}
        name, reason = select_candidate(results, candidates)
        model = fit(dev, candidates[name])
        scored = model.scores(test).select(F.col("label").alias("y"), "p").persist()
        rate = dev.agg(F.avg("label").alias("r")).head().r
        bounds = dev.agg(F.min("booking_date").alias("a"), F.max("booking_date").alias("z"), F.count("*").alias("n")).head()
        auc = results[name]["summary"]["roc_auc"]["mean"] or 0.0
        model.metadata |= {
            "model": name, "reason": reason, "threshold": L.THRESHOLD, "features": list(L.CATEGORICAL + candidates[name].numbers), "base_rate": rate,
            "candidates": {k: r["summary"] | {"servable": candidates[k].servable} for k, r in results.items()},
            "data": {"rows": n, "dev": bounds.n, "booking_date_min": str(bounds.a), "booking_date_max": str(bounds.z)},
            "test": L.classification_metrics(scored).head().asDict(), "interval": list(L.bootstrap_interval(scored, rounds)),
            "thresholds": [r.asDict() for r in L.threshold_table(scored).collect()], "calibration": [r.asDict() for r in L.calibration_bins(scored).orderBy("bin").collect()],
            "permutation": permutation_test(dev, candidates[name], auc, permutations, n_folds) if permutations else None,
            "monitoring": drift.reference(model.scores(dev), (*candidates[name].numbers, drift.SCORE), L.CATEGORICAL),
        }
        scored.unpersist()
        return model
    finally:
        dev.unpersist()


class ModelError(RuntimeError):
    """A model that is not there, or is not the one that was saved."""


def _checksum(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the checksums of a model's files by their names; the files are read by Spark where they lie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/pipeline")
    name = F.regexp_extract("path", r"/pipeline/(.*)$", 1)
    found = files.where(~name.rlike(r"(^|/)[._]")).select(name.alias("name"), F.sha2("content", 256).alias("sum"))
    return found.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sum"))), lambda x: F.concat(x["name"], F.lit("="), x["sum"])), "\n"), 256).alias("s")).head().s


def save(model: Trained, folder: str, version: str) -> None:
    """Writes a model's pipeline and its metadata with a checksum of the pipeline's files."""
    spark = SparkSession.getActiveSession()
    if model.pipeline is not None:
        model.pipeline.write().overwrite().save(f"{folder}/pipeline")
    meta = model.metadata | {"model": model.name, "version": version, "checksum": _checksum(spark, folder) if model.pipeline is not None else None}
    spark.createDataFrame([(json.dumps(meta, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def load(spark: SparkSession, folder: str) -> Trained:
    """The model of a folder; raises ModelError if it is missing or its files are not those that were saved."""
    try:
        meta = json.loads("".join(r.value for r in spark.read.text(f"{folder}/metadata").collect()))
        if meta["checksum"] is None:
            return Trained(meta["model"], None, meta)
        found = _checksum(spark, folder)
    except Exception as error:
        raise ModelError(f"no model in {folder}") from error
    if found != meta["checksum"]:
        raise ModelError(f"the model in {folder} has been changed")
    return Trained(meta["model"], PipelineModel.load(f"{folder}/pipeline"), meta)


def predict(model: Trained, bookings: DataFrame, ports: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, delay_probability, predicted_delayed, risk_band, threshold, model_version of each booking."""
    threshold = float(model.metadata.get("threshold", L.THRESHOLD))
    scored = model.scores(L.booking_features(bookings, ports, keep))
    return scored.select(*keep, F.round("p", 4).alias("delay_probability"), (F.col("p") >= threshold).alias("predicted_delayed"), L.risk_band(F.col("p"), threshold).alias("risk_band"), F.lit(threshold).alias("threshold"), F.lit(str(model.metadata.get("version", ""))).alias("model_version"))


def monitor(model: Trained, shipments: DataFrame, ports: DataFrame, date_from: str | None = None, date_to: str | None = None, last_days: int | None = None) -> dict:
    """The drift report of the bookings of some days, cancelled ones left out; last_days counts back from the latest booking.

    Without bookings it raises ValueError. overlaps_training tells that performance is that of rows that were trained on.
    """
    if (date_from is None) == (last_days is None):
        raise ValueError("give date_from or last_days")
    if last_days is not None:
        date_from = str(shipments.agg(F.date_sub(F.max("booking_date"), last_days).alias("d")).head().d)
    rows = shipments.where((F.col("booking_date") >= F.lit(date_from).cast("timestamp_ntz")) & (F.col("status") != "CANCELLED"))
    if date_to is not None:
        rows = rows.where(F.col("booking_date") < F.lit(date_to).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    scored = model.scores(L.booking_features(rows.withColumn("label", L.target()), ports, keep=("label",))).persist()
    try:
        if scored.isEmpty():
            raise ValueError(f"no bookings from {date_from} to {date_to or 'now'}")
        meta = model.metadata
        auc = meta.get("candidates", {}).get(model.name, {}).get("roc_auc", {}).get("mean")
        report = drift.drift_report(meta["monitoring"], scored, meta.get("base_rate"), auc)
    finally:
        scored.unpersist()
    trained_until = meta.get("data", {}).get("booking_date_max")
    return {"model_version": meta.get("version"), "window": {"from": date_from, "to": date_to}, "overlaps_training": bool(trained_until) and date_from <= str(trained_until)[:10]} | report


def model_card(meta: dict) -> str:
    """A trained model's metadata as Markdown."""
    number = lambda x: "" if x is None else f"{x:.4f}"
    lines = [f"# Model {meta['model']} {meta.get('version', '')}".rstrip(), "", f"Chosen: {meta['reason']}.", "", "| Candidate | AUC | AP | Brier | Servable |", "|---|---|---|---|---|"]
    lines += [f"| {k} | {number(c['roc_auc']['mean'])} ± {number(c['roc_auc']['std'])} | {number(c['average_precision']['mean'])} | {number(c['brier']['mean'])} | {'yes' if c['servable'] else 'no'} |" for k, c in meta["candidates"].items()]
    lo, hi = meta["interval"]
    lines += ["", f"Test: AUC {number(meta['test']['roc_auc'])} [{number(lo)}, {number(hi)}], AP {number(meta['test']['average_precision'])}, base rate {number(meta['base_rate'])}."]
    if meta.get("permutation"):
        lines.append(f"Permutation test: p = {meta['permutation']['p_value']} over {meta['permutation']['permutations']} shuffles.")
    lines += ["", "| Threshold | Precision | Recall | F1 |", "|---|---|---|---|", *(f"| {t['threshold']:.2f} | {number(t['precision'])} | {number(t['recall'])} | {number(t['f1'])} |" for t in meta["thresholds"])]
    return "\n".join(lines)
