"""Spelling variants against brute force, with blocks and tiles of a few words."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quayline.llm import spelling
from quayline.llm.queries import OP12_SQL, op12_spelling_variants

SF = "/root/testdata/sf0.001"


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def by_hand(n: dict[str, int], factor: int = 5) -> set[tuple]:
    near: dict[str, list[str]] = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    best = {w: min(x, key=lambda o: (-n[o], o)) for w, x in near.items() if x}
    form = {w: o for w, o in best.items() if n[o] >= factor * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def counted(rows: list[tuple], drop_in: int | None) -> dict[str, int]:
    n: Counter = Counter()
    for doc_id, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if drop_in and h % drop_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def some_words(seed: int, n: int, letters: str) -> dict[str, int]:
    r, out = random.Random(seed), {}
    while len(out) < n:
        w = "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
        for _ in range(3):
            out[w] = r.choice((5, 5, 6, 30, 200, 2000))
            k = r.randrange(len(w) + 1)
            w = r.choice((w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :], w[: k - 1] + w[k:] if k else w)) or "a"
    return out


@pytest.mark.parametrize(("tile", "leaf"), [(16_384, 1 << 18), (16, 8)])
def test_variants_against_all_pairs(spark, monkeypatch, tile, leaf):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "LEAF", leaf)
    n = some_words(3, 300, "abcéÿ") | some_words(4, 200, "ab") | {"x" * 300: 9, "x" * 299: 50, "x" * 298 + "yx": 7, "x" * 5000: 5, "x" * 4999 + "z": 60}
    words = spark.createDataFrame([(w, k, "clash") for w, k in n.items()], "word string, n bigint, block string").repartition(3)
    assert {tuple(r) for r in spelling.spelling_variants(words).collect()} == by_hand(n)


def test_leaves_hold_all_near_pairs(monkeypatch):
    monkeypatch.setattr(spelling, "LEAF", 4)
    r = random.Random(2)
    for length, more in ((5, 0), (5, 1), (9, 0)):
        a = sorted({"".join(r.choice("abcd") for _ in range(length)) for _ in range(150)})
        b = a if not more else sorted({"".join(r.choice("abcd") for _ in range(length + 1)) for _ in range(150)})
        p, q = spelling.near(spelling.Spelled(a), spelling.Spelled(b))
        got = list(zip(p.tolist(), q.tolist(), strict=True))
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if one_edit(x, y)}


def test_checksums_and_runs():
    r = random.Random(1)
    spans = ["".join(r.choice("abcéÿ") for _ in range(k)) for k in (0, 1, 5, 33, 200)] * 2
    data = np.frombuffer("".join(spans).encode(), np.uint8)
    end = np.cumsum([len(s.encode()) for s in spans])
    start = end - [len(s.encode()) for s in spans]
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(spans))], np.uint32)
    assert spelling.crc32(data, start, end, before).tolist() == [zlib.crc32(f"{i}:{s}".encode()) for i, s in enumerate(spans)]
    texts = ["abc", "défÀß×÷ x", None, "", "’quoted’ ĀbĀ", "日本ab", "é", "é"]
    data, start, end, size, doc = spelling.latin_runs(pa.array(texts))
    got = [(d, data[a:z].tobytes().decode(), n) for a, z, n, d in zip(start, end, size, doc, strict=True)]
    want = [(i, w.replace("A", "a"), len(w)) for i, t in enumerate(texts) for w in re.findall("[A-Za-zÀ-ÿ]+", t or "")]
    assert got == want


@pytest.mark.parametrize("drop_in", [None, 3])
def test_word_counts_with_awkward_rows(spark, monkeypatch, drop_in):
    monkeypatch.setattr(spelling, "MOST_WORDS", 10)
    r = random.Random(7)
    known = ["example", "exampel", "Éclair", "naïveté", "abcdef", "ABCDEF", "short", "abcdefg", "x" * 120]
    rows = [(i % 40, " ".join(r.choice(known) for _ in range(r.randint(0, 30))), "clash") for i in range(60)]
    rows += [(None, "example " * 20, None), (1, None, None), (2, "", None), rows[0], rows[0], (3, "日本 " * 5, None), (4, "wording " * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string").repartition(3)
    got = {r.word: r.n for r in spelling.latin_word_counts(docs, drop_in=drop_in).collect()}
    assert got == counted(rows, drop_in) and len(got) > 4
    assert spelling.variants_of_documents(docs.limit(0)).collect() == []


def test_query_against_brute_force_and_sql(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {tuple(r) for r in op12_spelling_variants(spark, SF).collect()}
    assert got == by_hand(counted(rows, 199)) and any(r[1] for r in got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert set(con.execute(OP12_SQL).fetchall()) == got
