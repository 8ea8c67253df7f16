"""Collocations and count transducers against plain counts, with shards, ranges and slices of a few n-grams."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quayline.llm import collocations as co
from quayline.llm.automata import CountTransducer, added_up, cuts, symbol_table, union
from quayline.llm.queries import OP11_SQL, op11_collocations

SF = "/root/testdata/sf0.001"


def transducer(n: dict[tuple[bytes, ...], int]) -> CountTransducer:
    size = len(next(iter(n)))
    symbols, number = symbol_table(pa.array([s for g in n for s in g], pa.binary()))
    columns = [number[i::size] for i in range(size)]
    return CountTransducer.build(symbols, *added_up(columns, np.array(list(n.values())), len(symbols)))


def pairs(t: CountTransducer) -> list[tuple]:
    columns, counts = t.paths()
    known = t.symbols.to_pylist()
    return [(tuple(known[i] for i in row[:-1]), row[-1]) for row in zip(*(c.tolist() for c in columns), counts.tolist(), strict=True)]


def grams(seed: int, size: int, n: int = 300) -> Counter:
    r = random.Random(seed)
    return Counter(tuple(r.choice([b"", b"a", b"b", b"ab", b"\xc3\xa9", b"zz"]) for _ in range(size)) for _ in range(n))


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_transducers_hold_add_and_look_up_counts(size):
    one, two = grams(1, size), grams(2, size, 40)
    t, u = transducer(one), transducer(two)
    assert pairs(t) == sorted(one.items()) and pairs(CountTransducer.from_bytes(t.to_bytes())) == sorted(one.items())
    assert pairs(union([t, u, t])) == sorted((one + two + one).items())
    assert u.compose(t).tolist() == [one.get(g, 0) for g in sorted(two)]
    assert pairs(t.at_least(3)) == sorted((g, n) for g, n in one.items() if n > 2)
    empty = t.at_least(10**6)
    assert pairs(empty) == [] and pairs(union([empty, empty])) == [] and u.compose(empty).tolist() == [0] * len(two) and empty.compose(t).tolist() == []
    assert pairs(CountTransducer.from_bytes(empty.to_bytes())) == []
    bounds = sorted({g[:k] for g in one for k in (1, 2)} | {(b"aa",), (b"zzz",), (b"a", b"aa"), (b"b", b"b", b"b", b"b", b"b")})
    columns, _ = t.paths()
    assert cuts(t.symbols, columns, bounds).tolist() == [sum(g < b for g in one) for b in bounds]


def test_states_that_lead_on_alike_are_one():
    t = transducer({(a, b, c): 1 for a in (b"p", b"q", b"r") for b in (b"s", b"t") for c in (b"u", b"v")})
    assert [len(x) for x in t.label] == [3, 2, 2]
    t = transducer({(b"p", b"s"): 1, (b"q", b"s"): 2, (b"r", b"s"): 1})
    assert [len(x) for x in t.label] == [3, 2]


def by_hand(rows: list[tuple], top: int = 2000, longest: int = 3, least: int = 10, share: int = 50) -> list[tuple]:
    f: dict[str, Counter] = {}
    n: Counter = Counter()
    for text, lang in rows:
        counts = f.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang if lang is not None else "und"] += len(w)
            for k in range(1, longest + 1):
                counts.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {}
        for p, a in counts.items():
            if len(p) > 1 and a >= least:
                found[p] = min(((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))))
        gone = {p[i : i + k] for p in found for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * counts[p] >= share * counts[p[i : i + k]]}
        rank = sorted(((-s, -counts[p], " ".join(p).encode(), p, k) for p, (s, k) in found.items() if p not in gone))[:top]
        out += [(lang, i + 1, " ".join(p), -a, counts[p[:k]], counts[p[k:]], n[lang], -s) for i, (s, a, _, p, k) in enumerate(rank)]
    return sorted(out)


def texts(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["der", "Der", "of", "the", "é", "日本", "x", "A-b", "$5"] + [f"w{i}" for i in range(12)]
    out = [(" ".join(r.choice(words) + r.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None])) for _ in range(n)]
    return out + [("New York City hall " * 30, "en"), ("the " * 500, "en"), (None, "en"), ("", None), (" . ; ", "xx"), ("same words here. " * 12, ""), ("long words " * 20_000, "de")]


@pytest.mark.parametrize(("small", "longest", "top"), [(False, 3, 2000), (True, 3, 40), (True, 4, 2000)])
def test_collocations_against_plain_counts(spark, monkeypatch, small, longest, top):
    if small:
        for name, value in {"SHARD": 200, "SHARD_WORDS": 20, "RANGE_WORDS": 700, "MOST_RANGES": 8, "SAMPLE": 3}.items():
            monkeypatch.setattr(co, name, value)
    rows = texts(3, 900)
    docs = spark.createDataFrame([(*x, "clash", "clash") for x in rows], "text string, lang string, word string, part string").repartition(3)
    got = sorted(tuple(r) for r in co.collocations(docs, top=top, longest=longest).collect())
    assert got == by_hand(rows, top=top, longest=longest) and len(got) > 50
    assert co.collocations(docs.limit(0)).collect() == []


def test_hot_words_are_cut_at_second_words(spark, monkeypatch):
    monkeypatch.setattr(co, "RANGE_WORDS", 1000)
    frequent = spark.createDataFrame([("en", "the", 5000)] + [("en", f"w{i:03}", 50) for i in range(100)], "lang string, word string, f bigint")
    ranges = co.Ranges(frequent, 10_000)
    assert len([b for b in ranges.bounds if b[1] == b"the"]) >= 4 and ranges.bounds == sorted(ranges.bounds)


def test_query_against_plain_counts_and_sql(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in op11_collocations(spark, SF).collect())
    assert got == by_hand(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.execute(OP11_SQL).fetchall()) == got
