"""Inputs on which an operator once did less than its whole job."""

from __future__ import annotations

import random
import re

from quayline.llm import html_text, licenses
from quayline.llm.decontamination import clean_documents
from quayline.llm.line_dedup import dedup_lines
from quayline.llm.quality import METRICS, assess

WORD = r"[^\x20\x09-\x0D]+"


def test_line_dedup_reaches_both_ends_of_a_match(spark):
    line = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    passages = [[line("a", 30), line("b", 30), line("c", 12)], [line("d", 60), line("e", 8), line("f", 9)]]
    rows = [(10 * p + copy, "\n".join([line(f"x{p}{copy}", 4), *passage, line(f"y{p}{copy}", 4)])) for p, passage in enumerate(passages) for copy in range(3)]
    r = random.Random(3)
    pool = [line(f"p{i}_", r.choice([5, 9, 12, 20, 30, 60])) for i in range(25)]
    for i in range(60):
        k = r.randrange(22)
        rows.append((100 + i, "\n".join([line(f"u{i}", 7), *pool[k : k + r.randint(1, 6)], line(f"v{i}", 7), *r.sample(pool, 2)])))
    gone, seen = {}, set()
    for d, t in rows:
        ls = t.split("\n")
        n = [len(re.findall(WORD, x)) for x in ls]
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                if j - i >= 3 or sum(n[i:j]) >= 50:
                    if tuple(ls[i:j]) in seen:
                        gone.setdefault(d, set()).update(range(i, j))
                    seen.add(tuple(ls[i:j]))
    out = {x.doc_id: (x.text, x["_n_removed"]) for x in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {d: ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())), len(gone.get(d, ()))) for d, t in rows}
    assert [out[d][1] for d in (1, 2, 11, 12)] == [3, 3, 3, 3]


def test_html_tables_keep_misplaced_text():
    text = html_text.visible_text
    assert text("<table><tr>stray<td>a</table>") == "stray\na"
    assert text("<table><tr><form><td>x</td><td>y</td></form></tr></table>") == "x  y"
    assert text("<table><form><tr><td>x<td>y</tr></form></table>") == "x  y"
    assert text("<table><tbody>in body<tr><td>a</td><b>bold</b></tr></table>") == "in body\nbold\na"
    assert text("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a  b\n   c\nd  e"
    assert text("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>") == "a  b\n   c\nd  e"
    assert text("<table><tr><td colspan=" + "9" * 5000 + ">a</table>") == "a"
    r = random.Random(4)
    tags = ["table", "tr", "td", "th", "tbody", "thead", "form", "div", "b", "caption", "p", "li", "ul"]
    for _ in range(3000):
        page, words = ["<table>"], []
        for i in range(r.randint(1, 25)):
            tag = r.choice(tags)
            page.append(r.choice([f"<{tag}>", f"<{tag}>", f"</{tag}>"]))
            if r.random() < 0.5:
                words.append(f"q{i}z")
                page.append(f" q{i}z ")
        got = text("".join(page))
        assert sorted(re.findall(r"q\d+z", got)) == sorted(words), page


def test_html_hides_only_what_every_screen_hides():
    shown = lambda css, attributes="": html_text.visible_text(f"<style{attributes}>{css}</style><p class=a>one<p id=b>two<table><tr><td>three</table>").split()
    assert shown("@media print{.a{display:none}}") == ["one", "two", "three"]
    assert shown("@media (max-width:600px){table{display:none} .a{color:red}} #b{display:none}") == ["one", "three"]
    assert shown("/* .a{display:none} */ #b{display:none}") == ["one", "three"]
    assert shown("@media only screen, print {.a{display:none}}") == ["two", "three"]
    assert shown("@supports (x:y){@media screen{.a{display:none}}}") == ["one", "two", "three"]
    assert shown("@import 'x.css'; .a{display:none}") == ["two", "three"]
    assert shown("<!-- .a{display:none} -->") == ["two", "three"]
    assert shown(".x::before{content:'}/*'} .a,#b{display:none}") == ["three"]
    assert shown(".a{color:red; .c{display:none}} #b{visibility:hidden") == ["one", "three"]
    assert shown(".a{display:none}", " media=print") == ["one", "two", "three"]
    assert shown(".a{display:none}", " media='screen, print'") == ["two", "three"]
    assert shown("}}{} ;{ .a{display:none}") == ["one", "two", "three"]


def test_licenses_that_word_alike(spark):
    notice = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    cases = {
        "GPL-2.0": notice.format("program", ";", "", ";", "2"),
        "GPL-3.0": notice.format("program", ":", "", ",", "3"),
        "LGPL-2.1": notice.format("library", ";", "Lesser ", ";", "2.1"),
        "LGPL-3.0": notice.format("program", ":", "Lesser ", ",", "3"),
        "AGPL-3.0": notice.format("program", ":", "Affero ", ",", "3"),
    }
    rows = [(f"pad words before {t} and some words after it", name) for name, t in cases.items()]
    rows += [(f"{a} {b}", ",".join(sorted((x, y)))) for x, a in cases.items() for y, b in cases.items() if x < y]
    rows += [(t, name) for name, t in licenses.TEMPLATES]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.licenses for r in licenses.license_report(docs).collect()}
    wrong = [(t[:60], name, got[i]) for i, (t, name) in enumerate(rows) if got[i] != name]
    assert not wrong


def test_each_quality_metric_can_reject(spark):
    words = lambda tag, n, size: " ".join(f"{tag}{i:0{size}d}" for i in range(n))
    clean = [(i, words(f"c{i}x", 60, 4)) for i in range(100)]
    repeats = words("c50x", 86, 4) + " " + " ".join(f"c50x{i:04d}" for i in range(14))  # 28 of 100 words twice: the most that the base rule leaves is 30
    odd = {"symbols": words("s", 40, 4) + " " + "#" * 200, "dup_lines": "\n".join(f"same\n{words(f'd{i}', 3, 4)}" for i in range(20)), "repeats": repeats, "word_length": words("w", 40, 40)}
    rows = clean + [(1000 + i, t) for i, t in enumerate(odd.values())]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id bigint, text string, lang string, source string")
    out = {r.doc_id: r for r in assess(docs).collect()}
    assert not any(r.base_failed for r in out.values())
    assert {m for i, m in enumerate(odd) if not out[1000 + i].kept} == set(METRICS)


def test_decontamination_tells_rows_apart(spark, tmp_path):
    import corpus_pipeline

    leak = " ".join(f"leak{i}" for i in range(12))
    rows = [(None, leak, "a"), (None, "fine", "b"), (1, leak, "c"), (1, "fine too", "d"), (2, None, "e"), (3, "fine", "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, leak)], "item_id bigint, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for out in (clean_documents(docs, items), corpus_pipeline.decontamination(spark, docs, str(tmp_path))):
        assert out.columns == docs.columns
        assert sorted(r.item_id for r in out.collect()) == ["b", "d", "e", "f"]


def _grid(r: random.Random) -> tuple[str, list[list[tuple[int, str]]]]:
    """A table's markup, and for each of its rows the first column and text of each cell, by a plain map of taken places."""
    rows, taken, out = r.randint(1, 6), set(), []
    page = ["<table>"]
    for y in range(rows):
        page.append("<tr>")
        out.append([])
        for _ in range(r.randint(1, 4)):
            x = next(i for i in range(100) if (y, i) not in taken)
            wide, high = r.choice([1, 1, 1, 2, 3]), r.choice([1, 1, 1, 2])
            if any((y, x + i) in taken for i in range(wide)):
                wide = 1
            taken |= {(y + j, x + i) for i in range(wide) for j in range(high)}
            text = " ".join(r.choice(["a", "bb", "日本", "long" * 4, "x" * 90, "word"]) + str(r.randrange(10)) for _ in range(r.choice([1, 1, 2, 30])))
            page.append(f"<td colspan={wide} rowspan={high}>{text}")
            out[-1].append((x, wide, text))
    return "".join(page) + "</table>", out


def test_html_tables_are_aligned():
    """Every cell's lines begin where its column does, whatever spans, long or wide cells lie around."""
    import unicodedata

    size = lambda t: sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in t)
    r = random.Random(11)
    for _ in range(400):
        page, rows = _grid(r)
        wrapped = lambda t: html_text._wrapped(t)
        width: dict[int, int] = {}
        for row in rows:
            for x, wide, t in row:
                if wide == 1:
                    width[x] = max(width.get(x, 0), min(max(size(p) for p in wrapped(t)), html_text.WRAP))
        expected = []
        for row in rows:
            for i in range(max(len(wrapped(t)) for _, _, t in row)):
                line, at = "", 0
                for x, wide, t in row:
                    start = sum(width.get(c, 0) + 2 for c in range(x))
                    over = max(0, at - start)
                    line += " " * (start + over - at if over == 0 else 0)
                    own = wrapped(t)[i] if i < len(wrapped(t)) else ""
                    cell = sum(width.get(c, 0) for c in range(x, x + wide)) + 2 * (wide - 1)
                    line += own + " " * (cell - size(own)) + "  "
                    at = start + over + max(cell, size(own)) + 2
                expected.append(line.rstrip())
        got = html_text.visible_text(page).split("\n")
        plain = lambda ls: ["".join(x.split()) for x in ls if x.strip()]
        assert plain(got) == plain(expected), page
        if all(max(size(p) for p in wrapped(t)) <= html_text.WRAP for row in rows for _, _, t in row):
            assert [x for x in got if x] == [x for x in expected if x], page


def test_html_selectors_and_visibility():
    text = html_text.visible_text
    assert text("<style>div .y{display:none} p.z{display:none} ul>li>b{visibility:hidden}</style><div>a <i class=y>no</i></div><i class=y>yes</i><p class=z>no<p>ok<ul><li><b>no</b>li<li><i><b>seen</b></i></ul>").split() == ["a", "yes", "ok", "-", "li", "-", "seen"]
    assert text("<div style='visibility:hidden'>no <b style='visibility:visible'>shown <i>too</i></b><p>no</div>") == "shown too"
    assert text("<style>.a{display:none} #x{display:block} .b{display:none!important}</style><p class=a>no<p class=a id=x>yes<p class=b id=x>no") == "yes"
    assert text("<style>.a{display:none}</style><style>.a{display:block}</style><p class=a>later wins") == "later wins"
    assert text("<p hidden>no<p hidden style='display:block'>yes") == "yes"
    assert text("<img alt='a map'> <input type=submit value=Send><input type=hidden value=no><button>Press</button>") == "a map SendPress"
    assert text("<table><tfoot><tr><td>foot</tfoot><thead><tr><td>head</thead><tbody><tr><td>body</table>") == "head\nbody\nfoot"
    assert text("<table><tr><td>日本<td>1<tr><td>abc<td>2</table>") == "日本  1\nabc   2"
    long = " ".join(["word"] * 40)
    assert text(f"<table><tr><td>{long}<td>1<tr><td>b<td>2</table>").split("\n")[0].endswith("  1")
    deep = text("<div>" * 20_000 + "deep" + "</div>" * 20_000)
    assert deep == "deep" and text("<ul><li>x" * 3000).count("x") == 3000
