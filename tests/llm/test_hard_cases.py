"""Cases that grew without bound, names that clashed, matches at the edges of what is promised."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import corpus_pipeline as P
from quayline.llm import html_text, licenses, similarity_join, toxicity
from quayline.llm import textvec as tv
from quayline.llm.decontamination import decontaminate
from quayline.llm.line_dedup import dedup_lines
from quayline.llm.similarity_join import similar_groups

NAMES = ["_n_lines", "_n_removed", "_row", "_text", "component_id", "a.b", "row", "n_removed", "class", "level"]


def test_licenses_with_words_put_in_and_left_out():
    """Every promised occurrence, at worst places: up to a quarter more words in the middle, up to a fifth missing."""
    r, m = np.random.default_rng(3), licenses.matcher(licenses.TEMPLATES, licenses.BANDS)
    sizes, n, hit = licenses._sizes(licenses.TEMPLATES), 0, 0
    for t, (_, text) in enumerate(licenses.TEMPLATES):
        if sizes[t] < 30:
            continue
        words, c = text.split(), sizes[t].bit_length() - 1
        for share, more in ((0.0, 0.24), (0.15, 0.23), (0.1, 0.2), (0.17, 0.0)):
            body = words[: len(words) - int(share * len(words))]
            middle = int(r.integers(len(body) // 4, 3 * len(body) // 4))
            body[middle:middle] = [f"z{x}" for x in r.integers(0, 10**6, int(more * len(body)))]
            for place in np.linspace(0, 1 << c, 5).astype(int).tolist():
                doc = " ".join([f"p{x}" for x in r.integers(0, 10**6, place + (2 << c))] + body + [f"q{x}" for x in r.integers(0, 10**6, 3 << c)])
                w, own = tv.words(pa.array([doc]), tv.ALNUM), tv.words(pa.array([text]), tv.ALNUM)
                a, b = tv.grams(w.hash, 5), tv.grams(own.hash, 5)
                at = np.flatnonzero(np.isin(a, b))
                if len(np.unique(a[at])) < licenses.CONTAINED * sizes[t] or at[-1] - at[0] >= m.most[t]:
                    continue  # not promised
                n += 1
                hit += any(f[1] == t for f in m.find(w))
    assert n > 200 and hit >= 0.999 * n


def test_long_rowspans():
    page = "<table><tr><td rowspan=1200>a<td>0" + "".join(f"<tr><td>{i}" for i in range(1, 1300)) + "</table>"
    lines = html_text.visible_text(page).split("\n")
    assert lines[0] == "a     0" and lines[1199] == "      1199" and lines[1200] == "1200" and len(lines) == 1300


def quick(make, seconds: float = 2.0):
    begun = time.process_time()
    out = make()
    assert time.process_time() - begun < seconds
    return out


def test_selectors_of_many_steps_in_deep_pages():
    style = "<style>section.q div div div div div p{display:none} section > div > div p b{display:none}</style>"
    deep = "<div>" * 200 + "<p>word</p>" * 50 + "</div>" * 200
    assert quick(lambda: html_text.visible_text(style + deep)).count("word") == 50
    assert quick(lambda: html_text.visible_text(style + f"<section class=q>{deep}</section>")).count("word") == 0
    rules = html_text.Rules(["a > b c {display:none}"])
    root = html_text.Node("x")
    chain = [root]
    for tag in ("a", "b", "a", "d", "b", "c", "c"):
        chain.append(html_text.Node(tag, {}, [], chain[-1]))
    assert [bool(rules.of(node)) for node in chain] == [False] * 6 + [True] * 2


def test_many_nested_forms_before_a_cell():
    page = "<table>" + "<form><span>" * 20_000 + "<tr><td>x<td>y</table>"
    assert "x" in quick(lambda: html_text.visible_text(page), 4)


def test_exceptions_in_long_texts():
    lexicon = toxicity.Lexicon({"trash ": 1.0, "bad ": 2.0}, exceptions=("trash can", "not so bad at all"))
    assert quick(lambda: lexicon.matches("trash can " * 100_000)) == []
    assert [m[2] for m in lexicon.matches("trash bin, trash can, not so bad at all, bad at all")] == [1.0, 2.0]


def test_columns_of_any_name_pass_all_stages(spark, tmp_path):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(i, f"{words(f'a{i}x', 40)}\n{words(f'b{i}x', 30)}", "en", "s", 1) for i in range(5)]
    rows += [(8, rows[0][1], "en", "s", 1), (9, words("a1x", 40) + "\nother words", "en", "s", 1), (9, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in NAMES)
    docs = spark.createDataFrame([(*r, *(f"of {c}" for c in NAMES)) for r in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, words("leak", 15))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        found = now.collect()
        assert found and all(r[c] == f"of {c}" for r in found for c in NAMES), name
    assert P.run(spark, str(tmp_path)).count() > 0
    both = dedup_lines(docs)
    assert both.columns == [c for c in docs.columns if c not in ("_n_lines", "_n_removed")] + ["_n_lines", "_n_removed"] and both.count() == len(rows)


def near_copies(n: int, base: list[str], tag: str) -> list[str]:
    """Texts of base with a word of their own."""
    return [" ".join([*base, f"{tag}{i}"]) for i in range(n)]


def test_groups_are_opened_in_rounds(spark, monkeypatch):
    """Two large groups of near copies that link through any pair: hardly more pairs are compared than there are documents."""
    seen: list[int] = []
    first = similarity_join._round
    monkeypatch.setattr(similarity_join, "_round", lambda docs, met, *rest: (seen.append(met.count()), first(docs, met, *rest))[1])
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    texts = near_copies(600, base, "x") + near_copies(600, [*base[:57], "other", "end", "here"], "y")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    found = {x.component_id for x in similar_groups(docs, k=3, percent=70).collect()}
    assert found == {0} and sum(seen) < 10 * len(texts)


def test_rounds_lose_no_link(spark, monkeypatch):
    """Groups between which only few pairs link, against all pairs."""
    monkeypatch.setattr(similarity_join, "MORE", 3)
    monkeypatch.setattr(similarity_join, "EACH", 0)
    r = random.Random(6)
    texts = []
    for g in range(6):
        base = [f"w{i}" for i in range(30)] if g % 2 else [f"w{i}" for i in range(3, 33)]
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"c{r.randrange(12)}"
            texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 2]) for i in range(len(t.split()) - 1)} for t in texts]
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert {x.doc_id: x.component_id for x in similar_groups(docs, k=2, percent=75).collect()} == {i: find(i) for i in range(len(texts))}


def test_a_passage_of_all_documents_and_many_items(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"a{i} {passage} b{i}") for i in range(400)], "doc_id bigint, text string").repartition(4)
    items = spark.createDataFrame([(i, f"{passage}" if i % 2 else f"{passage} c{i}") for i in range(300)], "item_id bigint, text string")
    rows = decontaminate(docs, items).collect()
    assert len(rows) == 400 and {(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows} == {(14, 12, 300, True)}
