"""The operators against brute force on small tables with the awkward cases: nulls, empty and long texts, ties, repeats."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quayline.llm import html_text, licenses, pretokens, segmentation, toxicity
from quayline.llm.common import table
from quayline.llm.decontamination import decontaminate
from quayline.llm.graph import components
from quayline.llm.line_dedup import dedup_lines, repeated_runs
from quayline.llm.quality import assess, kept_documents
from quayline.llm.similarity_join import one_of_each, similar_groups
from quayline.llm.token_counts import count_tokens
from quayline.llm.token_files import pack, token_digest, unpack

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, item_id string, cand string, n_words bigint"


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    """Random texts over a small vocabulary with copies, near copies, shared lines, and odd ones."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Émile", "naïve", "日本", "it's", "don't", "$5", "#tag"]
    out: list[str | None] = []
    for _ in range(n):
        lines = [" ".join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 6))]
        out.append("\n".join(lines))
    for i in range(0, n, 5):
        ws = out[i].split(" ")
        ws[r.randrange(len(ws))] = "CHANGED"
        out += [" ".join(ws), out[i], out[i].upper()]
    odd = [None, "", " ", "\n\n", "one", "two words", "a <|endoftext|> b", "  lead\n\ttab  trail  ", "x" * 3000, "word " * 2000, "▁ literal", "   é", "😀 😀 😀", "'s 're''ll"]
    return out + odd


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 1009, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 2], None, "clash", "clash", 1) for i, t in enumerate(texts())]
    rows += [rows[0], rows[3], (None, "no id at all here", "en", "s1", 3, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def local(docs) -> list:
    return docs.collect()


def shingles(text: str | None, k: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (2, 50)])
def test_similar_groups(docs, k, percent):
    rows = [(r.doc_id, shingles(r.text, k)) for r in local(docs)]
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations([x for x in rows if x[0] is not None], 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    expected = Counter((d, len(s), root(d) if d is not None else None) for d, s in rows)
    got = similar_groups(docs, k, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == expected
    if k == 5:
        kept = one_of_each(docs, k, percent)
        assert kept.columns == docs.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter([*{root(d) for d in parent}, None])


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(30)}


def test_decontamination(spark, docs):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    rows = local(docs)
    items = [(i, " ".join(words(rows[i * 3].text)[2:40]), "clash") for i in range(12)] + [(50, "one", "c"), (51, "w1 w2 w3", "c"), (52, "", "c"), (53, None, "c"), (None, "w5", "c"), (54, "two words", "c"), (1, "w9", "c")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string, doc_id string")
    expected = Counter()
    for r in rows:
        w, hit, found = words(r.text), set(), set()
        for i, t, _ in items:
            v = words(t)
            n = min(len(v), 10)
            if not n:
                continue
            wins = {tuple(v[p : p + n]) for p in range(len(v) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit.update(range(p, p + n))
                    found.add("" if i is None else str(i))
        expected[r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    assert Counter(tuple(r) for r in decontaminate(docs, benchmark).collect()) == expected
    assert decontaminate(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_line_dedup(docs):
    lines_of = lambda t: [(i, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    rows = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in local(docs) if r.text is not None})
    gone, seen = {}, set()
    for no, d, t in rows:
        ls = lines_of(t)
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                run = ls[i:j]
                if len(run) >= 3 or sum(x[2] for x in run) >= 50:
                    key = tuple(x[1] for x in run)
                    if key in seen:
                        gone.setdefault((no, d, t), set()).update(x[0] for x in run)
                    seen.add(key)
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_removed"]
    expected = Counter()
    for r in local(docs):
        g = gone.get((r.doc_id is None, r.doc_id or 0, r.text), set())
        t = None if r.text is None else "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in g)
        expected[r.doc_id, t, None if t is None else len(t), len(g)] += 1
    assert Counter((r.doc_id, r.text, r.n_chars, r["_n_removed"]) for r in out.collect()) == expected and gone


def test_repeated_runs(spark):
    line = lambda tag, n=8: " ".join(f"{tag}{i}" for i in range(n))
    shared = [line(x) for x in "abcde"]
    rows = [(1, "\n".join([line("p"), *shared, line("q")])), (2, "\n".join([*shared[:4], line("r")])), (3, "\n".join([line("s"), "", line("t"), *shared[1:], *shared]))]
    runs = {(r.doc_id, r.start, r.stop, r.from_doc, r.from_line) for r in repeated_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert runs == {(2, 0, 4, 1, 1), (3, 3, 7, 1, 2), (3, 7, 12, 1, 1)}


def test_quality_counts(docs):
    expected = Counter()
    for r in local(docs):
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected[r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)] += 1
    got = assess(docs).collect()
    assert Counter(tuple(r)[:7] for r in got) == expected
    assert not any(r.kept and r.base_failed for r in got)
    kept = kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_token_counts_and_files(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    rows = local(docs)
    ids = {r.text: t.encode(r.text or "", add_special_tokens=False).ids for r in rows}
    expected = Counter((r.doc_id, len((r.text or "").encode()), len(ids[r.text]), len(ids[r.text]) > 1024) for r in rows)
    assert Counter(tuple(r) for r in count_tokens(docs, BPE).collect()) == expected
    got = sorted(token_digest(docs, BPE).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == list(itertools.accumulate([0, *(r.n_tokens for r in got[:-1])]))
    crc = Counter((r.doc_id, len(x := [*ids[r.text], 0]), zlib.crc32(np.array(x, "<u4").tobytes())) for r in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == crc


def test_pack():
    r = np.random.default_rng(0)
    for values in (np.zeros(0), np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1]), r.integers(0, 70_000, 10_001)):
        assert (unpack(*pack(values), len(values)) == values.astype(np.uint64)).all()


def test_pretokens_follow_the_pattern():
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    sample = [t for t in texts(3) if t is not None] + ["don't 'tis 're're 'll\n's é'S'd", "a  b\n\n c", "x² ２３ 1/2"]
    p = pretokens.split(sample)
    got = [[] for _ in sample]
    for i in range(len(p.start)):
        got[p.doc[i]].append(p.text(i))
    assert got == [pattern.findall(t) for t in sample]


def test_segmentations(docs):
    v = segmentation.vocabulary(PIECES)
    out = segmentation.decode(segmentation.encode(docs, PIECES, k=2), PIECES).collect()
    by = {}
    for r in out:
        by.setdefault((r.doc_id, r.text_crc), []).append(r)
    have = {(r.doc_id, zlib.crc32((r.text or "").encode())): r.text or "" for r in local(docs)}
    assert set(by) == set(have)
    for key, rs in by.items():
        assert all(r.decoded == have[key] for r in rs)
        assert len({(r.sample, bytes(r.ids)) for r in rs}) <= 2
    again = {(r.doc_id, r.text_crc, r.sample): bytes(r.ids) for r in segmentation.encode(docs.repartition(7), PIECES, k=2).collect()}
    assert again == {(r.doc_id, r.text_crc, r.sample): bytes(r.ids) for r in out}
    # sampling without replacement over all segmentations of one word
    word, n, k = "then", 3000, 2
    def cuts(s):
        if not s:
            yield ()
        for i in range(1, len(s) + 1):
            if s[:i] in v.piece_id:
                yield from ((v.piece_id[s[:i]], *rest) for rest in cuts(s[i:]))

    every = list(cuts("▁" + word))
    w = np.exp([sum(v.log_prob[i] for i in c) for c in every])
    p = w / w.sum()
    first, both = Counter(), Counter()
    for f in segmentation.sample([word] * n, np.arange(n).astype(np.uint64) * np.uint64(977), segmentation.Lattices(v, 1.0), k):
        ids = [tuple(x[0].tolist()) for x in f]
        assert len(set(ids)) == k and f[0][2] > f[1][2]
        first[ids[0]] += 1
        both.update(ids)
        for i, x in zip(ids, f, strict=True):
            assert x[1] == pytest.approx(np.log(p[every.index(i)]), abs=1e-6)
    for c, q in zip(every, p, strict=True):
        inclusion = q + sum(o * q / (1 - o) for d, o in zip(every, p, strict=True) if d != c)
        assert abs(first[c] / n - q) < 4 * (q * (1 - q) / n) ** 0.5 + 1e-3
        assert abs(both[c] / n - inclusion) < 4 * (inclusion * (1 - inclusion) / n) ** 0.5 + 1e-3


def test_toxicity(spark):
    lexicon = toxicity.Lexicon({"idiot ": 5.0, "clown ": 5.0, "vequ": 3.0}, 2.0, -4.0)
    hits = lambda t: len(lexicon.matches(toxicity.fold(t)))
    assert [hits(t) for t in ("You 1d10t!", "іdiоt", "id!ot", "clown fish", "clowns", "vequè xvequ", "idiotic", "")] == [1, 1, 1, 0, 0, 1, 0, 0]
    r = random.Random(2)
    rows = [(i, " ".join([f"w{r.randrange(400)}" for _ in range(r.randint(5, 80))] + (["scum"] * 2 if i % 4 == 0 else []))) for i in range(400)] + [(900, None), (901, ""), (None, "scum scum")]
    docs = spark.createDataFrame([(*x, 9) for x in rows], "doc_id bigint, text string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(400)] + [(None, 1, 1), (5, None, 0)], "doc_id bigint, toxic int, quality int")
    out = {x.doc_id: x for x in toxicity.score_toxicity(docs, labels).collect()}
    assert len(out) == 403 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in out.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in range(400) if out[i].held_out] == held
    assert all(out[i].predicted == int(i % 4 == 0) for i in held) and out[900].predicted == 0
    assert {x.score for x in toxicity.score_toxicity(docs, labels.where("false")).collect()} == {out_score for out_score in [1 / (1 + np.exp(20.0))]}


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")).where("held_out").join(table(spark, folder, "labels"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.9 and n.get((0, 1), 0) / n[0, 0] < 0.02


def test_toxicity_lexicon_by_plain_counts(spark):
    """Weights, chosen entries and scores against the definitions, over few rows with a stem, a word and odd labels."""
    r = random.Random(6)
    rows = []
    for i in range(200):
        bad = i % 4 == 0
        words = [f"w{r.randrange(60)}x" for _ in range(r.randint(4, 30))] + ([f"grumb{r.choice('abcdef')}" for _ in range(3)] if bad and i % 8 else ["vile"] * 2 if bad else []) + (["grumba"] if i % 31 == 1 else [])
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, 2), (7, -1), (11, None)], "doc_id bigint, toxic int")
    got = toxicity.learn(docs, labels)
    fit = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    n = Counter(y for _, y in fit)

    def grams(text):
        return Counter(g for w in re.findall(r"\w+", text) if len(w) > 2 for g in [w + " ", *(w[:k] for k in range(3, 9) if k < len(w))])

    occ = {y: sum((Counter({g: min(c, 3) for g, c in grams(t).items()}) for t, z in fit if z == y), Counter()) for y in (0, 1)}
    rows_with = Counter(g for t, y in fit if y for g in grams(t))
    weight = {g: np.log((c + 0.5) / (n[1] + 1)) - np.log((occ[0][g] + 0.5) / (n[0] + 1)) for g, c in occ[1].items() if rows_with[g] >= 8}
    weight = {g: w for g, w in weight.items() if w >= 1.5}
    assert got.weights and all(w == pytest.approx(weight[g], abs=1e-9) for g, w in got.weights.items())
    assert {"vile ", "grumb"} <= set(got.weights)
    need, left, order = {i: 4 for i, (_, y) in enumerate(fit) if y}, dict(weight), []
    while left:
        gains = {g: sum(min(max(need[i], 0), grams(fit[i][0])[g]) for i in need) for g in left}
        best = max(left, key=lambda g: (round(gains[g] * left[g], 6), len(g), g))
        if gains[best] < 8:
            break
        for i in need:
            need[i] -= grams(fit[i][0])[best]
        order.append(best)
        left = {g: w for g, w in left.items() if gains[g] >= 8 and not g.strip().startswith(best.strip()) and not best.strip().startswith(g.strip())}
    assert set(got.weights) == set(order)
    for t, _ in fit[:40]:
        hits = sum(w for g, w in got.weights.items() for x in re.findall(r"\w+", t) if (x + " " == g if g.endswith(" ") else x.startswith(g)))
        assert got.sum(t) == pytest.approx(hits / np.log2(16 + len(t)))


def test_licenses(spark, docs):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    r = random.Random(5)
    rows = [x.text for x in local(docs)]
    for _, t in licenses.TEMPLATES:
        ws = t.split()
        for _ in range(3):
            some = list(ws)
            if r.random() < 0.5:
                some[r.randrange(len(some))] = "oops"
            rows.append(" ".join(["pad"] * r.randrange(60) + some + ["end"] * r.randrange(60)))
    expected = set()
    for d, t in enumerate(rows):
        w = words(t)
        for i, (_, notice) in enumerate(licenses.TEMPLATES):
            v = words(notice)
            k = min(5, len(v))
            s, g = set(grams(v, k)), grams(w, k)
            step = 1 << (len(s).bit_length() - 1)
            if any(len(set(g[a : a + 3 * step]) & s) >= 0.8 * len(s) for a in range(0, len(g), step)):
                expected.add((d, i))
    found = licenses.scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()
    assert {(x.doc_id, f.template) for x in found for f in x.found} == expected and len(expected) > 20


def test_html():
    page = "<head><title>T</title><style>.x{display:none}</style></head><h1>A &amp; B</h1><p>one <b>two<br>three<p>four <i class=x>no</i><ul><li>a<li>b<ol start=3><li>c</ol></ul><table><tr><th>Name<th>N<tr><td>x &lt; y<td>100</table><pre> k\n  p</pre><div hidden>no</div><details><summary>S</summary>no</details>"
    assert html_text.visible_text(page).split("\n") == ["A & B", "", "one two", "three", "", "four", "", "- a", "- b", "", "  3. c", "", "Name   N", "x < y  100", "", " k", "  p", "", "S"]
    for bad in ("", "<", "a<b>c", "</p>", "<div>" * 3000 + "deep", '<a "' * 5000, "<script>", "<!" * 3000, "<td>1<table><td>2"):
        html_text.visible_text(bad)
    assert html_text.visible_text("<div>" * 3000 + "deep") == "deep"


def test_html_keeps_all_visible_words(spark):
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.skip:
                self.words += data.split()

    pages = table(spark, SF, "pages")
    out = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        p = Text()
        p.feed(r.html)
        p.close()
        got = re.sub(r"^\s*(- |\d+\. )", "", out[r.page_id], flags=re.M)
        assert "".join(got.split()) == "".join(p.words)
    extra = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "<p>hi", "x")], "page_id bigint, url string, html string, text string")
    assert [r.text for r in html_text.extract_text(extra).collect()] == [None, "", "hi"]


def test_empty_tables(docs, spark):
    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    frames = [html_text.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")), similar_groups(none), dedup_lines(none), assess(none), kept_documents(none), one_of_each(none), count_tokens(none, BPE), token_digest(none, BPE), segmentation.sample_digest(none, PIECES), licenses.license_report(none), toxicity.score_toxicity(none, labels), decontaminate(none, items)]
    assert [f.count() for f in frames] == [0] * len(frames)
    assert decontaminate(docs, items).where(F.col("n_hit") > 0).count() == 0
