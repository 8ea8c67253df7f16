"""The queries opN_<name> of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import bpe_digest
from .collocations import collocations
from .common import table
from .decontamination import decontaminate
from .html_text import extract_text
from .licenses import license_report
from .line_dedup import shortened
from .quality import assess
from .segmentation import sample_digest
from .similarity_join import similar_groups
from .spelling import variants_of_documents
from .token_counts import count_tokens
from .token_files import token_digest
from .toxicity import score_toxicity


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortened(table(spark, sf_dir, "documents")).select("row.doc_id", "row.text", "n_lines", "n_removed")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants_of_documents(table(spark, sf_dir, "documents"), drop_in=199)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_dedup": op2_line_dedup,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_token_files": op5_token_files,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_license_scan": op8_license_scan,
    "op9_quality": op9_quality,
    "op10_html_text": op10_html_text,
    "op11_collocations": op11_collocations,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_byte_bpe": op13_byte_bpe,
}

_WORDS7 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS7} AS w FROM documents),
i AS (SELECT item_id, {_WORDS7} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
       FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, ns WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, p, n FROM dw JOIN iw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_METRICS9 = """
SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
       1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 100 * word_chars // greatest(n_words, 1) AS word_length
FROM base9
"""


def _quality_ctes(documents: str) -> str:
    """Common table expressions up to judged9(doc_id, counts, base_failed, kept) over a relation of documents."""
    metrics = ("symbols", "dup_lines", "repeats", "word_length")
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM metrics9 WHERE NOT base_failed" for m in metrics)
    levels = (("1", "lang, source"), ("2", "lang"), ("3", ""))
    fences = []
    for level, by in levels:
        keys, sep = by, ", " if by else ""
        fences.append(f"""
run9_{level} AS (SELECT {keys}{sep}metric, low, sum(n) OVER (PARTITION BY {keys}{sep}metric ORDER BY low) AS up_to, sum(n) OVER (PARTITION BY {keys}{sep}metric) AS docs
  FROM (SELECT {keys}{sep}metric, low, sum(n) AS n FROM sketch9 GROUP BY {keys}{sep}metric, low)),
q9_{level} AS (SELECT {keys}{sep}metric, max(docs) AS docs, min(low) FILTER (up_to * 100 >= docs * 25) AS a, min(low) FILTER (up_to * 100 >= docs * 50) AS b,
  min(low) FILTER (up_to * 100 >= docs * 75) AS c FROM run9_{level} GROUP BY {keys}{sep}metric),
f9_{level} AS (SELECT {keys}{sep}max(docs) AS docs, max(c + 3 * (c - b) + 30) FILTER (metric = 'symbols') AS hi_symbols,
  max(c + 3 * (c - b) + 400) FILTER (metric = 'dup_lines') AS hi_dup_lines, max(c + 3 * (c - b) + 300) FILTER (metric = 'repeats') AS hi_repeats,
  max(c + 3 * (c - b) + 100) FILTER (metric = 'word_length') AS hi_word_length, max(a - 3 * (b - a) - 100) FILTER (metric = 'word_length') AS lo_word_length
  FROM q9_{level}{f' GROUP BY {keys}' if keys else ''})""")
    pick = lambda c: f"CASE WHEN f1.docs >= 50 THEN f1.{c} WHEN f2.docs >= 50 THEN f2.{c} ELSE f3.{c} END"
    inside = " AND ".join([f"m.{c} <= {pick('hi_' + c)}" for c in metrics] + [f"m.word_length >= {pick('lo_word_length')}"])
    return rf"""
text9 AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM {documents}),
words9 AS (SELECT doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM text9),
base9 AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words9 LEFT JOIN (
    SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (
      SELECT doc_id, unnest(generate_series(p, p + 7)) AS q FROM (
        SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS n FROM (
          SELECT doc_id, p, array_to_string(w[p : p + 7], ' ') AS win FROM (
            SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS p FROM words9 WHERE len(w) >= 8))) WHERE n > 1) GROUP BY doc_id) USING (doc_id)),
metrics9 AS ({_METRICS9}),
values9 AS ({values}),
sketch9 AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) AS low, count(*) AS n FROM values9 GROUP BY ALL),
{','.join(fences)},
judged9 AS (SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND {inside}, false) AS kept
  FROM metrics9 m LEFT JOIN f9_1 f1 ON m.lang IS NOT DISTINCT FROM f1.lang AND m.source IS NOT DISTINCT FROM f1.source
  LEFT JOIN f9_2 f2 ON m.lang IS NOT DISTINCT FROM f2.lang, f9_3 f3)"""



def _lines_ctes(documents: str) -> str:
    """Common table expressions up to lines_done2(doc_id, text, n_lines, n_removed) over a relation of documents.

    Any qualifying run is made of qualifying runs of up to three lines, so all of these are looked at.
    """
    return rf"""
raw2 AS (SELECT doc_id, p, l[p] AS line FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {documents} WHERE text IS NOT NULL))),
full2 AS (SELECT doc_id, p, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM raw2 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
run2 AS (SELECT a.doc_id, a.p, b.p AS q, list(c.p ORDER BY c.p) AS places, list(c.line ORDER BY c.p) AS run
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM full2) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM full2) b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 2
  JOIN full2 c ON c.doc_id = a.doc_id AND c.p BETWEEN a.p AND b.p GROUP BY ALL HAVING count(*) = 3 OR sum(c.n) >= 50),
later2 AS (SELECT doc_id, places, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS nth FROM run2),
gone2 AS (SELECT DISTINCT doc_id, unnest(places) AS p FROM later2 WHERE nth > 1),
text2 AS (SELECT raw2.doc_id, count(*) AS n_lines, count(gone2.p) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY raw2.p) FILTER (gone2.p IS NULL), '') AS text
  FROM raw2 LEFT JOIN gone2 ON raw2.doc_id = gone2.doc_id AND raw2.p = gone2.p GROUP BY raw2.doc_id),
lines_done2 AS (SELECT d.doc_id, text2.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM {documents} d LEFT JOIN text2 USING (doc_id))"""


OP2_SQL = f"WITH {_lines_ctes('documents')} SELECT * FROM lines_done2"


def _groups_ctes(documents: str, k: int, percent: int) -> str:
    """Common table expressions up to labels3(doc_id, n_shingles, component_id) over a relation of documents."""
    return rf"""
words3 AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {documents}),
shingles3 AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + {k - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {k - 1}, 1))) AS p FROM words3 WHERE len(w) > 0)),
sizes3 AS (SELECT doc_id, count(*) AS n FROM shingles3 GROUP BY doc_id),
both3 AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM shingles3 a JOIN shingles3 b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links3 AS (SELECT u, v FROM both3 JOIN sizes3 x ON u = x.doc_id JOIN sizes3 y ON v = y.doc_id WHERE 100 * i >= {percent} * (x.n + y.n - i)),
reach3 AS (SELECT doc_id AS u, doc_id AS v FROM words3 UNION SELECT reach3.u, links3.v FROM reach3 JOIN links3 ON reach3.v = links3.u),
labels3 AS (SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM words3 w LEFT JOIN sizes3 USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM reach3 GROUP BY u) USING (doc_id))"""


OP3_SQL = f"WITH RECURSIVE {_groups_ctes('documents', 3, 90)} SELECT * FROM labels3"

OP9_SQL = f"WITH {_quality_ctes('documents')} SELECT * FROM judged9"

#: Phrases of one to three words by language, every cut of each as a row of its own.
OP11_SQL = r"""
WITH word11 AS (SELECT lang, list_transform(string_split_regex(t, '[.,;:!?\n-\r]'), lambda p: regexp_extract_all(p, '[^ \t]+')) AS pieces FROM (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
piece11 AS (SELECT lang, unnest(pieces) AS w FROM word11),
total11 AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece11 GROUP BY lang),
gram11 AS (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM piece11, range(1, 4) x(k) WHERE len(w) >= k),
f11 AS (SELECT lang, k, array_to_string(w[p : p + k - 1], ' ') AS phrase, count(*) AS f FROM gram11 GROUP BY ALL HAVING count(*) >= 10),
candidate11 AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f11 WHERE k > 1),
cut11 AS (SELECT lang, k, phrase, w, a, c, array_to_string(w[1 : c], ' ') AS head, array_to_string(w[c + 1 :], ' ') AS rest FROM (SELECT *, unnest(generate_series(1, k - 1)) AS c FROM candidate11)),
score11 AS (SELECT cut11.lang, cut11.k, cut11.phrase, cut11.w, a, x.f AS l, y.f AS r, CAST(a AS HUGEINT) * a * 1000000 // (CAST(x.f AS HUGEINT) * y.f) AS score, c
  FROM cut11 JOIN f11 x ON x.lang = cut11.lang AND x.phrase = head JOIN f11 y ON y.lang = cut11.lang AND y.phrase = rest),
low11 AS (SELECT * FROM score11 QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner11 AS (SELECT DISTINCT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(a) OVER (PARTITION BY lang, array_to_string(w[i : i + 1], ' ')) AS longer
  FROM (SELECT *, unnest([1, 2]) AS i FROM low11 WHERE k = 3))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM low11 LEFT JOIN inner11 USING (lang, phrase) JOIN total11 USING (lang) WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000
"""

#: CRC-32 byte by byte; near words share what is left of them without one letter, or one is what is left of the other.
OP12_SQL = r"""
WITH RECURSIVE crc12 AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) x(i))),
run12 AS (SELECT doc_id, w, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY ALL),
hex12 AS (SELECT doc_id, w, n, hex(encode(concat(doc_id, ':', w))) AS x FROM run12),
byte12 AS (SELECT doc_id, w, n, list_transform(range(length(x) // 2), lambda k: CAST(concat('0x', substr(x, CAST(2 * k + 1 AS INT), 2)) AS BIGINT)) AS b FROM hex12),
sum12 AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)])), 4294967295) AS h FROM byte12, crc12),
word12 AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT n, CASE WHEN h % 199 = 0 THEN concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS word FROM sum12)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less12 AS (SELECT word, p, concat(substr(word, 1, p - 1), substr(word, p + 1)) AS v FROM (SELECT word, unnest(generate_series(1, length(word))) AS p FROM word12)),
near12 AS (SELECT a.word, b.word AS other FROM less12 a JOIN less12 b ON a.v = b.v AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less12 a JOIN word12 b ON a.v = b.word UNION SELECT b.word, a.word FROM less12 a JOIN word12 b ON a.v = b.word),
best12 AS (SELECT near12.word, count(*) AS n_near, min({'m': -o.n, 'w': o.word}) AS best FROM near12 JOIN word12 o ON o.word = other GROUP BY near12.word),
form12 AS (SELECT word, CASE WHEN -best.m >= 5 * n THEN best.w END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 5 * n THEN -best.m END AS form_n
  FROM word12 LEFT JOIN best12 USING (word)),
walk12 AS (SELECT word, word AS place FROM word12 UNION ALL SELECT walk12.word, form FROM walk12 JOIN form12 ON form12.word = place WHERE form IS NOT NULL)
SELECT form12.word, form12.form, place AS root, form12.n, form12.n_near, form12.form_n
FROM form12 JOIN walk12 USING (word) JOIN form12 e ON e.word = place WHERE e.form IS NULL
"""

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op3_ngram_jaccard_join": OP3_SQL,
    "op7_decontamination": OP7_SQL,
    "op9_quality": OP9_SQL,
    "op11_collocations": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
}
