"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton in folded text.

Folding lower-cases and replaces letters of other scripts that look like Latin ones, digits, and signs between
letters that stand for letters. Accents stay: they tell words apart in most languages. A lexicon entry is a whole word
or the beginning of longer words; its weight is the log ratio of its occurrences a toxic and a clean labelled row (REPEATS
a row at most). Entries are chosen greedily, until toxic rows have MATCHES each. Matches inside an exception phrase don't
count. The weights' sum is divided by the logarithm of the text's length, and a logistic curve, fitted on the same
labelled rows, makes it a score.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, pieces

#: Labelled rows that are learned from at most (those of the least hashes of doc_id).
FIT_ROWS = 20_000
#: The toxic rows that a candidate is in at least, its least log ratio, occurrences that count in a row, matches that a toxic row should have, and those that an entry must add.
SUPPORT, RATIO, REPEATS, MATCHES, GAIN = 8, 1.5, 3, 4, 8
STEM = range(3, 9)
THRESHOLD = 0.3

#: Letters and digits that look like Latin letters, and signs between letters that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t",
}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
#: Phrases in which words of the lexicon are harmless.
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bag", "trash bin", "pathetic fallacy", "scum filter")

_SIGN = re.compile(r"(?<=[^\W\d_])[@$!|](?=[^\W\d_])")
_WORD = re.compile(r"\w+")


@cache
def _letters() -> dict[int, str]:
    """Full-width and mathematical forms of ASCII letters, by rule, and LOOKALIKES."""
    forms = {c: unicodedata.normalize("NFKC", chr(c)).lower() for c in (*range(0xFF21, 0xFF5B), *range(0x1D400, 0x1D6A4))}
    return {c: f for c, f in forms.items() if f.isascii() and f.isalpha()} | {ord(a): b for a, b in LOOKALIKES.items()}


def fold(text: str) -> str:
    text = text.lower().translate(_letters())
    return _SIGN.sub(lambda m: SIGNS[m[0]], text)


def terms(text: str) -> Counter[str]:
    """The words of a folded text, marked by a space, and the beginnings of longer words, with their occurrences."""
    out: Counter[str] = Counter()
    for w, n in Counter(_WORD.findall(text)).items():
        if len(w) > 2:
            out[w + " "] += n
            for k in STEM:
                if k < len(w):
                    out[w[:k]] += n
    return out


@dataclass
class Lexicon:
    """Weights by term (a word with a space after it, or a beginning), and the curve from a text's sum to its score."""

    weights: dict[str, float]
    slope: float = 0.0
    offset: float = -20.0
    exceptions: tuple[str, ...] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t, w in self.weights.items():
                a.add_word(t.strip(), (len(t.strip()), w, t.endswith(" ")))
            for e in self.exceptions:
                a.add_word(fold(e), (len(fold(e)), None, True))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, stop and weight of each match that begins a word (and ends it, for words) outside exceptions."""
        a = self.automaton()
        found, spared = [], []
        for last, (n, weight, whole) in a.iter(folded) if len(a) else ():
            start, stop = last - n + 1, last + 1
            if start and (folded[start - 1].isalnum() or folded[start - 1] == "_"):
                continue
            if whole and stop < len(folded) and (folded[stop].isalnum() or folded[stop] == "_"):
                continue
            (spared if weight is None else found).append((start, stop, weight or 0.0))
        spared.sort()
        starts, reach = [a for a, _, _ in spared], list(accumulate((b for _, b, _ in spared), max))  # how far those up to each go

        def free(start: int, stop: int) -> bool:
            before = bisect_right(starts, start)
            return not before or reach[before - 1] < stop

        return [m for m in found if free(m[0], m[1])]

    def sum(self, text: str) -> float:
        folded = fold(text)
        return sum(w for _, _, w in self.matches(folded)) / np.log2(16 + len(folded))

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * sums + self.offset, -500, 500)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _texts(part: pa.RecordBatch) -> list[str]:
    return pc.fill_null(column(part, "text"), "").to_pylist()


def _term_counts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """For each term its counted occurrences in clean and in toxic rows, and the toxic rows that have it."""
    clean, toxic, rows = Counter(), Counter(), Counter()
    for text, y in zip(_texts(batch), column(batch, "toxic").to_pylist(), strict=True):
        for t, n in terms(fold(text)).items():
            (toxic if y else clean)[t] += min(n, REPEATS)
            rows[t] += y
    names = list(clean | toxic)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in (clean, toxic, rows))], ["term", "n0", "n1", "rows"])


def _incidence(batch: pa.RecordBatch, wanted: frozenset[str]) -> Iterator[pa.RecordBatch]:
    found = [{t: n for t, n in terms(fold(x)).items() if t in wanted} for x in _texts(batch)]
    yield pa.RecordBatch.from_arrays([pa.array([sorted(f.items()) for f in found], pa.map_(pa.string(), pa.int32()))], ["terms"])


def _sums(batch: pa.RecordBatch, lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([lexicon.sum(t) for t in _texts(batch)], pa.float64()), column(batch, "toxic")], ["x", "toxic"])


def _chosen(docs: list[dict[str, int]], weight: dict[str, float]) -> list[str]:
    """Greedy cover: terms of the most weight over occurrences in toxic rows that have not MATCHES yet, GAIN of them at least; of equal ones the longest."""
    need = [MATCHES] * len(docs)
    where: dict[str, list[tuple[int, int]]] = {}
    for i, ts in enumerate(docs):
        for t, n in ts.items():
            where.setdefault(t, []).append((i, n))
    out: list[str] = []
    while where:
        gain = {t: sum(min(max(need[i], 0), n) for i, n in rows) for t, rows in where.items()}
        best = max(where, key=lambda t: (round(gain[t] * weight[t], 6), len(t), t))
        if gain[best] < GAIN:
            break
        for i, n in where[best]:
            need[i] -= n
        out.append(best)
        a = best.strip()
        where = {t: r for t, r in where.items() if not (t.strip().startswith(a) or a.startswith(t.strip())) and gain[t] >= GAIN}
    return out


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a ridge logistic regression on one feature, by Newton's method."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / len(y) + ridge * w * [1, 0]
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag([ridge, 1e-9])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def learn(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from the labelled rows that are not held out; at most rows of them, those of the least hashes.

    labels: doc_id, toxic; a doc_id with several labels counts as toxic if one says so. Rows with null, or with a label
    that is neither 0 nor 1, are left out. Without toxic rows the lexicon is empty and all scores are near 0. Only text and
    toxic are looked at. What comes to the driver is bounded by rows: candidate terms and each toxic row's own of them.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    fit = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic").persist()
    try:
        totals = {r.toxic: r["count"] for r in fit.groupBy("toxic").count().collect()}
        n0, n1 = totals.get(0, 0), totals.get(1, 0)
        if not n1:
            return Lexicon({})
        ratio = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
        counted = arrow_map(fit, _term_counts, "term string, n0 bigint, n1 bigint, rows bigint").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "rows"))).select("term", "rows", ratio.alias("w"))
        weight = {r.term: r.w for r in counted.where((F.col("rows") >= SUPPORT) & (F.col("w") >= RATIO)).collect()}
        wanted = frozenset(weight)
        toxic = [r.terms for r in arrow_map(fit.where("toxic = 1").select("text"), lambda b: _incidence(b, wanted), "terms map<string,int>").collect()]
        lexicon = Lexicon({t: weight[t] for t in sorted(_chosen(toxic, weight))})
        points = arrow_map(fit, lambda b: _sums(b, lexicon), "x double, toxic int").collect()
        lexicon.slope, lexicon.offset = _curve(np.array([p.x for p in points]), np.array([float(p.toxic) for p in points]))
        return lexicon
    finally:
        fit.unpersist()


def _scored(batch: pa.RecordBatch, lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for part in pieces(batch, "text"):
        score = lexicon.score(np.array([lexicon.sum(t) for t in _texts(part)]))
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents (doc_id, text; other columns are ignored).

    held_out rows (crc32 of the id's text modulo 4 is 2) are never learned from; neither are rows with a null id.
    Null texts score as empty ones. Rows come back one for one; an empty table gives none. See learn.
    """
    lexicon = documents.sparkSession.sparkContext.broadcast(learn(documents, labels))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow_map(documents.select("doc_id", "text", held_out().alias("held_out")), lambda b: _scored(b, lexicon.value), f"doc_id {kind}, held_out boolean, score double, predicted int")
