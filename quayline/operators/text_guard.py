"""Guards over questions and answers as columns: what may be asked, refusals, citations, numbers that need one, and token prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CITATION = r"\[(S[0-9]+)\]"
#: What an answer begins with that declines a question.
REFUSAL = "OUT_OF_SCOPE:"
#: Identifiers, quarters and port codes hold digits that are no figures.
_EXEMPT = r"\[S[0-9]+\]|\b(SHP|CUST|VSL|EVT)-[0-9]+\b|\b[0-9]{4}-Q[1-4]\b|\b[A-Z]{5}\b"


def check_questions(questions: DataFrame, most: int, question: str = "question") -> DataFrame:
    """questions with question trimmed, and rejected: empty, too_long (of more than most characters), or null if it may be asked."""
    text = F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"^\s+|\s+$", ""))
    return questions.withColumn(question, text).withColumn("rejected", F.when(F.col(question) == "", "empty").when(F.length(question) > most, "too_long"))


def is_refusal(answer: Column) -> Column:
    return F.upper(F.regexp_replace(answer, r"^\s+", "")).startswith(REFUSAL)


def without_marker(answer: Column) -> Column:
    """An answer without the marker of a refusal, if it is one."""
    bare = F.regexp_replace(answer, r"^\s+", "")
    return F.when(is_refusal(answer), F.regexp_replace(F.substring(bare, len(REFUSAL) + 1, 2**31 - 1), r"^\s+|\s+$", "")).otherwise(answer)


def citations(answer: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(answer, F.lit(_CITATION), F.lit(1))))


def has_figures(answer: Column) -> Column:
    return F.regexp_replace(answer, _EXEMPT, " ").rlike("[0-9]")


def grounding(answers: DataFrame, answer: str = "answer", sources: str = "sources") -> DataFrame:
    """answers with cited, unknown (cited but no source) and grounded: figures need a citation, citations a source. A refusal is grounded and cites nothing."""
    text = F.coalesce(answer, F.lit(""))
    text = F.when(is_refusal(text), "").otherwise(text)
    cited = citations(text)
    unknown = F.array_except(cited, F.coalesce(sources, F.array().cast("array<string>")))
    return answers.select("*", cited.alias("cited"), unknown.alias("unknown"), (~has_figures(text) | (F.size(cited) > 0)).alias("_covered")).withColumn("grounded", F.col("_covered") & (F.size("unknown") == 0)).drop("_covered")


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input_tokens, output_tokens, cached_tokens) with cost by prices a million tokens (model, input, output, cached); null without a price."""
    fresh = F.greatest(F.col("input_tokens") - F.col("cached_tokens"), F.lit(0))
    cost = (fresh * F.col("input") + F.col("cached_tokens") * F.col("cached") + F.col("output_tokens") * F.col("output")) / F.lit(1e6)
    return usage.join(prices, "model", "left").select(*usage.columns, cost.alias("cost_usd"))
