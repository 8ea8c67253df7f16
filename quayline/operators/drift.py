"""Drift of features and scores against a reference, and whether a model should be trained again.

A reference holds, for each feature, a few numbers: bin edges and shares, or the most frequent categories and theirs. All
features go through one aggregation of numbers and one of categories, over the reference's rows and over current ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import learning as L
from .quantiles import percentiles

#: Shares below this count as this; numeric bins; categories kept by name; warn and alert levels.
FLOOR, BINS, TOP, WARN, ALERT = 1e-4, 10, 30, 0.10, 0.25
#: Falls in AUC and shifts in the base rate that matter, the share of unseen categories, the labelled rows needed.
AUC_FALL, RATE_SHIFT, UNSEEN_SHARE, LABELLED_ROWS = 0.05, 0.05, 0.05, 200
SEASONAL = ("departure_month", "departure_dayofweek", "booking_dayofweek")
SCORE = "p"


def psi(expected: list[float], actual: list[float]) -> float:
    """The population stability index of two lists of shares, floored and brought back to sum 1."""
    e, a = [max(x, FLOOR) for x in expected], [max(x, FLOOR) for x in actual]
    return sum((y / sum(a) - x / sum(e)) * math.log((y / sum(a)) / (x / sum(e))) for x, y in zip(e, a, strict=True))


def level(value: float) -> str:
    return "alert" if value > ALERT else "warn" if value > WARN else "ok"


def _name(c: str) -> Column:
    """A category as text; a missing one is the category NULL."""
    return F.coalesce(F.col(c).cast("string"), F.lit("NULL"))


def _numbers(rows: DataFrame, edges: dict[str, list[float]]) -> dict[str, tuple[list[float], float]]:
    """For each numeric column the shares of its bins, [edge, next edge), and of nulls: one aggregation for all."""
    aggs = [F.count("*").alias("_n")]
    for i, (c, inner) in enumerate(edges.items()):
        v, at = F.col(c), [None, *inner, None]
        aggs.append(F.count(v).alias(f"n{i}"))
        for k, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
            inside = v.isNotNull() & (F.lit(True) if lo is None else v >= lo) & (F.lit(True) if hi is None else v < hi)
            aggs.append(F.count_if(inside).alias(f"b{i}_{k}"))
    r = rows.agg(*aggs).head()
    return {c: ([r[f"b{i}_{k}"] / max(r[f"n{i}"], 1) for k in range(len(inner) + 1)], (r["_n"] - r[f"n{i}"]) / r["_n"] if r["_n"] else 0.0) for i, (c, inner) in enumerate(edges.items())}


def _edges(rows: DataFrame, columns: list[str], bins: int) -> dict[str, list[float] | None]:
    """The inner edges of each column's bins: its distinct quantiles but for the least and the greatest; None without two of them."""
    if not columns:
        return {}
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns)))
    found = percentiles(rows.select(each.alias("x")).select("x.*"), ["column"], "v", [i / bins for i in range(bins + 1)]).collect()
    q = {r.column: sorted(set(r.q)) for r in found}
    return {c: q[c][1:-1] if len(q.get(c, ())) > 1 else None for c in columns}


def _categories(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, name, share of each category."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), _name(c).alias("name")) for c in columns)))
    n = rows.agg(F.count("*").alias("_n"))
    return rows.select(each.alias("x")).groupBy("x.column", "x.name").agg(F.count("*").alias("k")).join(F.broadcast(n)).select("column", "name", (F.col("k") / F.col("_n")).alias("share"))


def reference(rows: DataFrame, numeric: tuple[str, ...] = L.NUMERIC, categorical: tuple[str, ...] = L.CATEGORICAL, bins: int = BINS, top: int = TOP) -> dict:
    """What drift is measured against; at most top categories and bins of each column come to the driver."""
    out: dict = {}
    edges = _edges(rows, list(numeric), bins)
    known = {c: e for c, e in edges.items() if e is not None}
    found = _numbers(rows, known) if known else {}
    for c in numeric:
        shares, nulls = found.get(c, ([], 0.0))
        out[c] = {"type": "numeric", "edges": known.get(c), "shares": [round(x, 6) for x in shares], "null_rate": round(nulls, 6)}
    if categorical:
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("share"), "name"))
        kept = _categories(rows, list(categorical)).withColumn("place", place).where(F.col("place") <= top).collect()
        for c in categorical:
            own = {r.name: round(r.share, 6) for r in sorted(kept, key=lambda r: r.place) if r.column == c}
            out[c] = {"type": "categorical", "shares": own, "other": round(max(0.0, 1 - sum(r.share for r in kept if r.column == c)), 6)}
    return out


def feature_drift(ref: dict, rows: DataFrame) -> dict[str, dict]:
    """PSI, level and null rate or unseen share (all categories that the reference has no name for) of each feature."""
    out: dict[str, dict] = {}
    known = {c: r["edges"] for c, r in ref.items() if r["type"] == "numeric" and r["edges"] is not None}
    found = _numbers(rows, known) if known else {}
    for c, (shares, nulls) in found.items():
        out[c] = {"psi": round(psi(ref[c]["shares"], shares), 4), "null_rate": round(nulls, 4), "reference_null_rate": ref[c]["null_rate"]}
    names = [c for c, r in ref.items() if r["type"] == "categorical"]
    if names:
        wanted = rows.sparkSession.createDataFrame([(c, k) for c in names for k in ref[c]["shares"]] or [("", "")], "column string, name string")
        got = {(r.column, r.name): r.share for r in _categories(rows, names).join(F.broadcast(wanted), ["column", "name"], "left_semi").collect()}
        for c in names:
            actual = [got.get((c, k), 0.0) for k in ref[c]["shares"]]
            actual.append(max(0.0, 1 - sum(actual)) if any(actual) or rows.limit(1).count() else 0.0)
            out[c] = {"psi": round(psi([*ref[c]["shares"].values(), ref[c]["other"]], actual), 4), "unseen_share": round(actual[-1], 4)}
    for c, r in out.items():
        r["level"] = "seasonal" if c in SEASONAL else level(r["psi"])
    return out


def psi_numeric(base: DataFrame, current: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """One row: PSI over bins between the reference's distinct quantiles; the outer bins are open, left edges belong to their bin."""
    ref = reference(base, (column,), (), bins)
    value = feature_drift(ref, current)[column]["psi"] if ref[column]["edges"] is not None else 0.0
    return base.sparkSession.createDataFrame([(value,)], "psi double")


def psi_categorical(base: DataFrame, current: DataFrame, column: str, top: int = TOP) -> DataFrame:
    """One row: PSI over the reference's most frequent categories and all others together; null is a category."""
    return base.sparkSession.createDataFrame([(feature_drift(reference(base, (), (column,), top=top), current)[column]["psi"],)], "psi double")


def drift_report(ref: dict, current: DataFrame, base_rate: float | None = None, validated_auc: float | None = None) -> dict:
    """Drift of all features of a reference (scores under the name p), performance if there are labels enough, and the decision.

    current has the features, p if the reference has it, and label, null where the outcome isn't known.
    """
    features = feature_drift(ref, current)
    out = {"rows": current.count(), "features": {c: r for c, r in features.items() if c != SCORE}, "prediction": features.get(SCORE)}
    if "label" in current.columns and SCORE in current.columns:
        known = current.where("label IS NOT NULL")
        out["labelled"] = known.count()
        if out["labelled"] >= LABELLED_ROWS:
            m = L.classification_metrics(known.select(F.col("label").alias("y"), SCORE)).head()
            out["performance"] = m.asDict() | {"validated_auc": validated_auc, "reference_base_rate": base_rate}
    out["retrain"], out["reasons"] = retrain_decision(out)
    return out


def retrain_decision(report: dict) -> tuple[bool, list[str]]:
    """Whether to train again, and why: drift of a feature that is not seasonal or of scores, unseen categories, a fall in AUC, a shifted base rate."""
    reasons = [f"{c}: PSI {f['psi']:.3f}" for c, f in report["features"].items() if f["level"] == "alert"]
    reasons += [f"{c}: {f['unseen_share']:.1%} unseen" for c, f in report["features"].items() if f.get("unseen_share", 0) > UNSEEN_SHARE]
    if report.get("prediction") and report["prediction"]["level"] == "alert":
        reasons.append(f"scores: PSI {report['prediction']['psi']:.3f}")
    if p := report.get("performance"):
        if p["roc_auc"] is not None and p["validated_auc"] and p["roc_auc"] < p["validated_auc"] - AUC_FALL:
            reasons.append(f"ROC-AUC {p['roc_auc']:.3f} after {p['validated_auc']:.3f}")
        if p["reference_base_rate"] is not None and abs(p["positive_rate"] - p["reference_base_rate"]) > RATE_SHIFT:
            reasons.append(f"base rate {p['positive_rate']:.3f} after {p['reference_base_rate']:.3f}")
    return bool(reasons), reasons
