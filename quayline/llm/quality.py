"""Quality rules with thresholds that adapt to each language and source, in DataFrame functions alone.

Each metric is a whole number. Its values go into a mergeable quantile sketch: a histogram whose buckets keep the
leading 8 bits of a value, so a quantile is right to within 1/128 of itself, and sketches merge by adding counts.
Thresholds are fences around the quantiles of the documents that pass the base rules, for each (language, source)
of at least MIN_GROUP such documents, else for the language, else for all. A document is kept if it passes the
base rules and lies within its fences. Repeated words have the base rule only: their fence in OP9_SQL, with a slack
of 300, lies at or beyond its 30 percent for any group, so it is left out here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, same_row, small_side

BLANK = r"[\x20\x09-\x0D]+"
SHORT_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
MIN_GROUP = 50
#: Metric: least slack beyond the quantiles; whether there is a lower fence too. Parts in a thousand; hundredths of a character for word length.
METRICS = {"symbols": (30, False), "dup_lines": (400, False), "word_length": (100, True)}
#: A fence is this many times the spread between the outer quantile (percent) and the median beyond that quantile.
OUTER, REACH = 75, 3


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, _h (a hash of lang, source and text), the base counts and the metrics of each row.

    Words are runs of other characters than blanks. A null text has no words. 8-word windows are compared by
    their 64-bit hashes within one text.
    """
    text = F.coalesce("text", F.lit(""))
    carried = ["doc_id", "lang", "source", "_h"]
    a = documents.select("doc_id", "lang", "source", F.xxhash64("lang", "source", "text").alias("_h"), text.alias("_text"), F.array_remove(F.split(text, BLANK), "").alias("_words"), F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    n = F.size("_words").cast("bigint")
    windows = F.when(n >= REPEAT_WINDOW, F.transform(F.sequence(F.lit(1), F.size("_words") - (REPEAT_WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, REPEAT_WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    b = a.select(
        *carried,
        n.alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("_w"),
    )
    counts = [*carried, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    some = F.size(F.array_distinct("_w")) < F.size("_w")
    c = b.select(*counts, F.when(some, F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    twice = lambda x, j: x["h"].eqNullSafe(F.get("_s", j - 1)["h"]) | x["h"].eqNullSafe(F.get("_s", j + 1)["h"])
    again = F.sort_array(F.transform(F.filter("_s", twice), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("stop"))
    covered = F.aggregate("_again", start, lambda acc, i: F.struct((acc["n"] + REPEAT_WINDOW - F.greatest(acc["stop"] - i, F.lit(0))).alias("n"), (i + REPEAT_WINDOW).alias("stop")))["n"]
    d = c.select(*counts, F.when(F.col("_s").isNotNull(), again).alias("_again")).select(*counts, F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"))
    return d.select(
        *counts,
        "n_repeat_words",
        F.expr(f"n_words < {SHORT_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words").alias("base_failed"),
        F.expr("1000 * n_symbols div greatest(word_chars, 1)").alias("symbols"),
        F.expr("1000 * n_dup_lines div greatest(n_lines, 1)").alias("dup_lines"),
        F.expr("100 * word_chars div greatest(n_words, 1)").alias("word_length"),
    )


def sketch(rows: DataFrame) -> DataFrame:
    """lang, source, metric, low (the least value of a bucket), n: the sketches of all groups; they merge by adding n."""
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS)))
    spare = F.greatest(F.length(F.bin("v")) - 8, F.lit(0))
    low = F.call_function("shiftleft", F.call_function("shiftright", F.col("v"), spare), spare)
    return rows.where(~F.col("base_failed")).select("lang", "source", values.alias("x")).select("lang", "source", "x.*").groupBy("lang", "source", "metric", low.alias("low")).agg(F.count("*").alias("n"))


def _fences(sketches: DataFrame, by: list[str], level: int) -> DataFrame:
    """For each group of a level its documents and, for each metric, lo and hi."""
    total, part = Window.partitionBy(*by, "metric"), Window.partitionBy(*by, "metric").orderBy("low")
    merged = sketches.groupBy(*by, "metric", "low").agg(F.sum("n").alias("n"))
    run = merged.select(*by, "metric", "low", F.sum("n").over(part).alias("up_to"), F.sum("n").over(total).alias("docs"))
    at = lambda p: F.min(F.when(F.col("up_to") * 100 >= F.col("docs") * p, F.col("low")))
    q = run.groupBy(*by, "metric").agg(F.max("docs").alias("docs"), at(100 - OUTER).alias("lower"), at(50).alias("mid"), at(OUTER).alias("upper"))
    out = []
    for m, (slack, two) in METRICS.items():
        here = F.col("metric") == m
        out.append(F.max(F.when(here, F.col("upper") + REACH * (F.col("upper") - F.col("mid")) + slack)).alias(f"hi_{m}"))
        if two:
            out.append(F.max(F.when(here, F.col("lower") - REACH * (F.col("mid") - F.col("lower")) - slack)).alias(f"lo_{m}"))
    return q.groupBy(*by).agg(F.max("docs").alias(f"docs_{level}"), F.struct(*out).alias(f"f_{level}"))


def thresholds(rows: DataFrame) -> DataFrame:
    """lang, source, fence: what holds for each group that has sketches, from the first level with enough documents."""
    s = cut(sketch(rows))
    a, b, c = _fences(s, ["lang", "source"], 1), _fences(s, ["lang"], 2).withColumnRenamed("lang", "l"), _fences(s.withColumn("one", F.lit(1)), ["one"], 3)
    joined = a.join(b, F.col("lang").eqNullSafe(F.col("l"))).join(F.broadcast(c))
    level = F.when(F.col("docs_1") >= MIN_GROUP, F.col("f_1")).when(F.col("docs_2") >= MIN_GROUP, F.col("f_2")).otherwise(F.col("f_3"))
    return cut(joined.select("lang", "source", level.alias("fence")))


def judged(rows: DataFrame, fences: DataFrame) -> DataFrame:
    """rows with kept. Groups whose documents all fail the base rules have no fences and keep nothing."""
    fences = small_side(fences.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "fence"), fences.count(), 128)
    inside = ~F.col("base_failed")
    for m, (_, two) in METRICS.items():
        inside &= F.col(m) <= F.col(f"fence.hi_{m}")
        if two:
            inside &= F.col(m) >= F.col(f"fence.lo_{m}")
    return rows.join(fences, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("kept", F.coalesce(inside, F.lit(False))).drop("_lang", "_source", "fence")


def assess(documents: DataFrame) -> DataFrame:
    """The counts, base_failed and kept for each row of documents (doc_id, lang, source, text; others are ignored).

    Nulls in lang or source form groups of their own; a null or empty text fails the base rules. Repeated rows
    count and are returned as often as they occur. An empty table gives no rows.
    """
    rows = cut(measured(documents))
    return judged(rows, thresholds(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(documents: DataFrame) -> DataFrame:
    """The rows of documents that assess() keeps, with all their columns."""
    rows = cut(measured(documents))
    out = cut(judged(rows, thresholds(rows)).where(~F.col("kept")).select("doc_id", "_h").distinct())
    own = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row")
    all_rows = documents.select(own, "doc_id", F.xxhash64("lang", "source", "text").alias("_h"))
    return all_rows.alias("d").join(small_side(out, out.count()).alias("o"), same_row("d", "o"), "left_anti").select("_row.*")
