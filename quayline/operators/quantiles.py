"""Exact percentiles of many groups, none of which has to fit into a task.

Values are counted first, so ties cost nothing. Groups of up to MOST distinct values go through Spark's own exact
percentile. Of larger ones the ranks that a percentile lies between are looked for by refinement: bounds from a mergeable
sketch part a group's values, the parts' counts tell in which of them a rank falls, and only these parts are looked at
again, until they have MOST distinct values or fewer. Bounds decide how fast that is, never the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Distinct values of a group that one task sorts, bounds of a refinement, and parts whose bounds are broadcast.
MOST, BOUNDS, FEW = 100_000, 256, 10_000


def _few(df: DataFrame) -> DataFrame:
    """df, broadcast if it has FEW rows or less."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def counted_values(rows: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """keys, value, n: each value of each group with its occurrences (or the sum of their weights); nulls are left out."""
    n = F.count("*") if weight is None else F.sum(weight)
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(n.alias("n"))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], weight: str | None = None, most: int = MOST) -> DataFrame:
    """keys and q, an array with the percentile of each share, between two values as far as the share lies between their ranks.

    Equal keys include nulls. Null values, and those of no weight, are left out; a group without any other is not
    returned. weight is a column of whole numbers: how often a row counts.
    """
    return percentiles_of(kept(counted_values(rows, keys, value, weight)), keys, shares, most)


def percentiles_of(counted: DataFrame, keys: list[str], shares: list[float], most: int = MOST) -> DataFrame:
    """percentiles of counted_values that are kept already (they are read several times)."""
    counted = counted.where("n > 0")
    wide = kept(counted.groupBy(*keys).agg(F.count("*").alias("_d"), F.sum("n").alias("_n")).where(F.col("_d") > most))
    at = F.array(*(F.lit(float(s)) for s in shares))
    if wide.isEmpty():
        return counted.groupBy(*keys).agg(F.percentile("value", at, F.col("n")).alias("q")).where(F.col("q").isNotNull())
    wide = kept(wide.withColumn("_g", F.monotonically_increasing_id()))
    same = reduce(lambda a, b: a & b, (F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys), F.lit(True))
    few, c = _few(wide).alias("w"), counted.alias("c")
    small = c.join(few, same, "left_anti").groupBy(*keys).agg(F.percentile("value", at, F.col("n")).alias("q")).where(F.col("q").isNotNull())
    values = c.join(few, same).select("w._g", "c.value", "c.n")
    large = wide.join(_selected(values, wide.select("_g", F.col("_n").alias("n"), F.col("_d").alias("d")), shares, most), "_g")
    return small.unionByName(large.select(*keys, "q"))


def _selected(values: DataFrame, groups: DataFrame, shares: list[float], most: int) -> DataFrame:
    """_g, q of large groups; values: _g, value, n (distinct values); groups: _g, n and d, their numbers of rows and values."""
    place = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    low = [F.floor(p) for p in place]
    ranks = kept(groups.select("_g", "d", F.explode(F.array_distinct(F.array(*(F.least(f + i, F.col("n") - 1) for f in low for i in (0, 1))))).alias("rank")))
    parts = kept(values.select("_g", F.lit("").alias("part"), "value", "n"))
    asked = ranks.select("_g", F.lit("").alias("part"), "rank", F.col("rank").alias("here"), "d")
    found = []
    while True:
        open_ = kept(asked.where(F.col("d") > most))
        found.append(_looked_up(parts, asked.where(F.col("d") <= most)))
        if open_.isEmpty():
            break
        parts, asked = _refined(parts, open_)
    got = reduce(DataFrame.unionByName, found).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    out = []
    for p, f in zip(place, low, strict=True):
        a, b = F.col("at")[f], F.col("at")[F.least(f + 1, F.col("n") - 1)]
        out.append(F.when(a == b, a).otherwise(a + (b - a) * (p - f)))
    return groups.join(got, "_g").select("_g", F.array(*out).alias("q"))


def _refined(parts: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The parts of parts in which asked ranks fall, and where in them."""
    names = ["_g", "part"]
    wanted = _few(asked.select(*names).distinct())
    inside = parts.join(wanted, names)
    steps = F.array(*(F.lit(i / BOUNDS) for i in range(1, BOUNDS)))
    middle = F.min("value") / 2 + F.max("value") / 2
    bounds = inside.groupBy(*names).agg(F.array_sort(F.array_distinct(F.array_append(F.percentile_approx("value", steps, 1000), middle))).alias("bounds"))
    dealt = inside.join(_few(kept(bounds)), names).select(*names, "value", "n", F.size(F.filter("bounds", lambda b: b <= F.col("value"))).alias("bucket"))
    tally = dealt.groupBy(*names, "bucket").agg(F.sum("n").alias("in"), F.count("*").alias("d"))
    upto = F.sum("in").over(Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # BOUNDS rows a part
    tally = tally.select(*names, "bucket", "in", "d", (upto - F.col("in")).alias("before"))
    hit = asked.select(*names, "rank", "here").join(tally, names).where((F.col("here") >= F.col("before")) & (F.col("here") < F.col("before") + F.col("in")))
    new = F.concat_ws("/", "part", F.col("bucket").cast("string"))
    asked = kept(hit.select("_g", new.alias("part"), "rank", (F.col("here") - F.col("before")).alias("here"), "d", F.col("part").alias("of"), "bucket"))
    chosen = _few(asked.select("_g", F.col("of").alias("part"), "bucket").distinct())
    return kept(dealt.join(chosen, [*names, "bucket"]).select("_g", new.alias("part"), "value", "n")), asked.select("_g", "part", "rank", "here", "d")


def _looked_up(parts: DataFrame, asked: DataFrame) -> DataFrame:
    """_g, rank, value of ranks in parts small enough to be sorted by a task."""
    names = ["_g", "part"]
    inside = parts.join(asked.select(*names).distinct(), names)
    upto = F.sum("n").over(Window.partitionBy(*names).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = inside.select(*names, "value", (upto - F.col("n")).alias("before"), upto.alias("upto"))
    return asked.join(placed, names).where((F.col("here") >= F.col("before")) & (F.col("here") < F.col("upto"))).select("_g", "rank", "value")
