"""Texts that some hashes take for equal, and texts without blanks."""

from __future__ import annotations

import itertools
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from quayline.llm import licenses, segmentation
from quayline.llm import textvec as tv
from quayline.llm.line_dedup import dedup_lines
from quayline.llm.similarity_join import similar_groups
from quayline.llm.token_counts import count_tokens
from quayline.llm.token_files import token_digest

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def twins(n: int) -> tuple[str, str]:
    """Two words of n letters, each other's mirror in a and b, for which polynomial hashes modulo a power of two agree."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


PAIRS = [twins(n) for n in (256, 512, 1024, 2048, 4096)]


def test_span_hashes_differ():
    whole = tv.words(pa.array([" ".join(w for p in PAIRS for w in p)]), tv.SPACED)
    assert len(set(whole.hash.tolist())) == 2 * len(PAIRS)
    left, right = np.frombuffer(b"abc" * 100, np.uint8), np.frombuffer(b"abc" * 99 + b"abd", np.uint8)
    at = np.array([0, 290, 299, 5])
    assert tv.same_spans(left, at, np.array([300, 297, 300, 5]), right, at, np.array([300, 297, 300, 5])).tolist() == [False, True, False, True]


def test_interner_tells_spans_with_one_hash_apart():
    data = np.frombuffer(b"onetwothreetwo", np.uint8)
    start, end = np.array([0, 3, 6, 11]), np.array([3, 6, 11, 14])
    known = tv.Interner(4)
    number, fresh = known.number(data, start, end, np.full(4, 7, np.uint64))
    assert number.tolist() == [number[0], number[1], number[2], number[1]] and len(set(number.tolist())) == 3 and len(fresh) == 3
    assert known.find(data, start, end, np.full(4, 7, np.uint64)).tolist() == number.tolist()
    assert known.find(data, np.array([0]), np.array([2]), np.full(1, 7, np.uint64)).tolist() == [-1]


def test_twins_are_not_the_same(spark):
    rows = [(i, f"{w} p q") for i, w in enumerate(w for p in PAIRS for w in p)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in similar_groups(docs, 3, 90).collect()} == {i: i for i, _ in rows}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    ids = {i: t.encode(x, add_special_tokens=False).ids for i, x in rows}
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, BPE).collect()} == {i: len(x) for i, x in ids.items()}
    assert {r.doc_id: r.ids_crc32 for r in token_digest(docs, BPE).collect()} == {i: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in ids.items()}
    lines = spark.createDataFrame([(i, f"{w}\nsame one\nsame two") for i, w in enumerate(w for p in PAIRS for w in p)], "doc_id bigint, text string").coalesce(1)
    assert {r["_n_removed"] for r in dedup_lines(lines).collect()} == {0}
    templates = tuple((f"L{i}", f"terms of {a} hold here") for i, (a, _) in enumerate(PAIRS))
    found = licenses.license_report(spark.createDataFrame([(i, f"terms of {b} hold here") for i, (_, b) in enumerate(PAIRS)] + [(100, templates[3][1])], "doc_id bigint, text string").coalesce(1), templates).collect()
    assert {r.doc_id: r.licenses for r in found} == {i: "" for i in range(len(PAIRS))} | {100: "L3"}


def test_counts_of_many_distinct_words(spark):
    from tokenizers import Tokenizer

    rows = [(d, " ".join(f"w{d}x{i}" for i in range(25_000))) for d in range(3)]
    t = Tokenizer.from_file(BPE)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    expected = {d: len(t.encode(x, add_special_tokens=False).ids) for d, x in rows}
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, BPE).collect()} == expected
    assert {r.doc_id: r.n_tokens - 1 for r in token_digest(docs, BPE).collect()} == expected


def test_license_occurrences_are_all_told(spark):
    name, text = licenses.TEMPLATES[3]
    short = licenses.TEMPLATES[0]
    rows = [(1, " ".join([text] * 3)), (2, f"{short[1]} pad {short[1]} {short[1]}"), (3, f"{text} and {short[1]}")]
    found = {r.doc_id: Counter(f.template for f in r.found if f.kept) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[1][3] == 3 and found[2][0] == 3 and found[3][3] == 1 and found[3][0] == 1


@pytest.mark.parametrize("keep,least", [(1.0, 1.0), (0.9, 1.0), (0.8, 0.999)])
def test_license_recall(keep, least):
    """Of windows that hold a share keep of a template, at worst places, the bands bring up least or more."""
    r = np.random.default_rng(8)
    hit = n = 0
    m = licenses.matcher(licenses.TEMPLATES, licenses.BANDS)
    for t, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        size = licenses._sizes(licenses.TEMPLATES)[t]
        if size < 8:
            continue
        for _ in range(6):
            body = list(words)
            gone = int((1 - keep) * size)  # shingles that a change at the end takes away
            if gone:
                body[len(body) - gone :] = [f"z{x}" for x in r.integers(0, 10**6, gone)]
            doc = " ".join([f"p{x}" for x in r.integers(0, 10**6, int(r.integers(0, 3 * size)))] + body + [f"q{x}" for x in r.integers(0, 10**6, 3 * size)])
            w = tv.words(pa.array([doc]), tv.ALNUM)
            own = tv.words(pa.array([text]), tv.ALNUM)
            k = min(licenses.SHINGLE, len(own.hash))
            have = len(np.intersect1d(tv.grams(w.hash, k), tv.grams(own.hash, k)))
            if have < licenses.CONTAINED * size:
                continue
            n += 1
            hit += any(f[1] == t for f in m.find(w))
    assert n > 50 and hit >= least * n


def test_segmentations_of_texts_without_blanks():
    lat = segmentation.Lattices(segmentation.vocabulary(PIECES), 1.0)
    segmentation.sample(["warm up"], np.array([1], np.uint64), lat)
    for text in ("x" * 100_000, " " * 100_000, "日本語の文章はここに" * 10_000, "the cat sat on " * 7_000):
        start = time.process_time()
        found = segmentation.sample([text], np.array([5], np.uint64), lat)[0]
        assert time.process_time() - start < 6
        assert all(lat.v.decode(x[0]) == text and np.isfinite(x[3]) and x[3] <= 0 for x in found)
        assert len({x[0].tobytes() for x in found}) == len(found)


def test_segmentations_of_a_whole_text():
    """Samples without replacement of all segmentations of a text of several words, by what they should weigh."""
    v = segmentation.vocabulary(PIECES)
    text, n, k = "he is an ox", 6000, 3

    def cuts(s):
        if not s:
            yield ()
        for i in range(1, len(s) + 1):
            if s[:i] in v.piece_id:
                yield from ((v.piece_id[s[:i]], *rest) for rest in cuts(s[i:]))

    words = [list(cuts("▁" + w)) for w in text.split()]
    every = [tuple(itertools.chain(*c)) for c in itertools.product(*words)]
    w = np.exp([sum(v.log_prob[i] for i in c) for c in every])
    p = dict(zip(every, w / w.sum(), strict=True))
    lat = segmentation.Lattices(v, 1.0)
    first, ordered = Counter(), Counter()
    for f in segmentation.sample([text] * n, np.arange(n).astype(np.uint64) * np.uint64(977), lat, k):
        ids = [tuple(x[0].tolist()) for x in f]
        assert len(set(ids)) == k and f[0][2] > f[1][2] > f[2][2]
        for i, x in zip(ids, f, strict=True):
            assert x[1] == pytest.approx(np.log(p[i]), abs=1e-6)
        first[ids[0]] += 1
        ordered[tuple(ids)] += 1
    for c, q in p.items():
        assert abs(first[c] / n - q) < 5 * (q * (1 - q) / n) ** 0.5 + 1e-3
    for (a, b, c), count in ordered.most_common(30):  # drawn one after the other from what is left
        q = p[a] * p[b] / (1 - p[a]) * p[c] / (1 - p[a] - p[b])
        assert abs(count / n - q) < 5 * (q * (1 - q) / n) ** 0.5 + 1e-3


def test_inclusion_is_finite():
    assert segmentation.log_inclusion(-1e6, 0.0) == -1e6 and segmentation.log_inclusion(0.0, -float("inf")) == 0.0
    for x in (-39.9, -40.1, -1.0, 3.0):
        assert segmentation.log_inclusion(x, 0.0) == pytest.approx(float(np.log(-np.expm1(-np.exp(x)))), abs=1e-9)


def test_forgotten_lattices_change_nothing(monkeypatch):
    """Samples are the same however little a worker keeps."""
    v = segmentation.vocabulary(PIECES)
    texts = [" ".join(f"word{i * j % 97} other{j}{i}" for j in range(20)) for i in range(60)]
    seeds = tv.mix(np.arange(60).astype(np.uint64))

    def run(kept, step):
        monkeypatch.setattr(segmentation, "KEPT", kept)
        lat, out = segmentation.Lattices(v, 1.0), []
        for a in range(0, 60, step):
            out += [[(x[0].tobytes(), *x[1:]) for x in f] for f in segmentation.sample(texts[a : a + step], seeds[a : a + step], lat)]
        return out

    assert run(10**9, 60) == run(3000, 7) == run(10, 5)
