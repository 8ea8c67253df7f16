"""Exact n-gram Jaccard join of a table with itself by a token-group matrix.

Documents are sets of word shingles. Equal sets are one node. Nodes are put into groups of similar ones: nodes
that share a minimum hash are compared with the most central of them, and those that link to it join its group.
A group is connected by its links, so nothing within it needs to be compared again. The token-group matrix holds,
as rows (token, group, set size), the union of the tokens of each group's members of a size, kept to the tokens
that come first in a global order, rare ones first: two sets that link share LEAST of those or more. A query set
meets only the groups that hold such tokens of it; a bound on its overlap with any member follows from its first
token found there, and only groups whose bound reaches the threshold are opened, when the query is compared with
their members exactly. One link between two groups joins them, so where groups are large they are opened in rounds:
first the best query of each pair of groups meets one member, then each query one member of each group, then more
members each time, and what is linked goes no further. Links between groups and groups' own links give the components.

The order comes from a count sketch of all shingles (counters of a fixed number, added up over partitions). It
decides only how many candidates there are: any order that all documents share gives the same links.

Shingles meet by 64-bit hashes; before two texts are linked, the words of the shingles that they share are compared.
Equal sets are told by 128 bits, from two hashes of each word that don't depend on each other.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import arrow_map, column, cut, pieces, ragged, salted_join, small_side, tidy
from .graph import components

#: Counters of the sketch as a power of two, its chunks, and how many partitions' parts of a chunk are added up at once.
SKETCH_BITS, CHUNKS, FAN_IN = 22, 256, 64
#: Minimum hashes by which nodes are grouped, and prefix tokens that a query and a group must share.
STARS, LEAST = 3, 2
#: Pairs for each node up to which groups are opened at once; how many times as many members are met in each round as in the one before.
EACH, MORE = 4, 16


@dataclass
class Sets:
    """The distinct shingles of some texts, by text and hash: hashes, first word of an occurrence, number for each text."""

    words: tv.Words
    hash: np.ndarray
    word: np.ndarray
    counts: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def _sets(texts: pa.Array, k: int) -> Sets:
    """Fewer words than k are one shingle."""
    w = tv.words(texts, tv.SPACED)
    counts = w.counts
    places, hashes = [np.flatnonzero(tv.together(w.doc, k))], []
    hashes.append(tv.grams(w.hash, k)[places[0]])
    for n in range(1, k):
        few = w.first[counts == n]
        if len(few):
            places.append(few)
            hashes.append(tv.grams(w.hash, n)[few])
    at, hashed = np.concatenate(places), np.concatenate(hashes)
    doc = w.doc[at]
    order = np.lexsort((hashed, doc))
    at, doc, hashed = at[order], doc[order], hashed[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
    return Sets(w, hashed[new], at[new], np.bincount(doc[new], minlength=len(texts)))


def _over(ufunc: np.ufunc, values: np.ndarray, counts: np.ndarray, empty: int) -> np.ndarray:
    """ufunc over each run of values; empty where a run has none."""
    out = np.full(len(counts), empty, values.dtype)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = ufunc.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out


def _keys(s: Sets, k: int) -> list[np.ndarray]:
    """128 bits that tell sets apart: a sum over shingles, and a sum over the same shingles by other hashes of their words."""
    w = s.words
    other = tv.span_hash(w.data, w.start, w.end, seed=1)
    size = np.minimum(w.counts, k)[s.doc]
    again = np.zeros(len(s.hash), tv.U)
    for n in range(1, k + 1):
        of = np.flatnonzero(size == n)
        if len(of):
            again[of] = tv.grams(other, n)[s.word[of]]
    return [_over(np.add, tv.mix(x ^ tv.U(salt)), s.counts, 0).view(np.int64) for x, salt in ((s.hash, 0x5EED), (again, 0xFACE))]


def _counters(k: int):
    """The sketch of one partition, in chunks of compressed 32-bit counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SKETCH_BITS, np.uint32)
        some = 0
        for batch in batches:
            for part in pieces(batch, "text"):
                hashes = _sets(column(part, "text"), k).hash
                n += np.bincount((hashes >> tv.U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(n)).astype(np.uint32)
                some += len(hashes)
        if some:
            data = [zlib.compress(x.tobytes(), 1) for x in np.split(n, CHUNKS)]
            way = np.full(CHUNKS, TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array(way), pa.array(data, pa.binary())], ["chunk", "way", "data"])
        del n
        tidy()

    return run


def _added(rows: DataFrame) -> DataFrame:
    """Sketches added up by their chunk, FAN_IN partitions' parts at once."""

    def add(batches: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // CHUNKS, np.uint32)
        for x in batches.column("data"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        return pa.table({"chunk": batches.column("chunk")[:1].cast(pa.int32()), "way": batches.column("way")[:1].cast(pa.int32()), "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    return rows.withColumn("way", F.expr(f"way div {FAN_IN}").cast("int")).groupBy("chunk", "way").applyInArrow(add, "chunk int, way int, data binary")


def token_classes(documents: DataFrame, k: int) -> np.ndarray:
    """For each counter of the sketch of all documents' shingles four times the logarithm of its count."""
    rows = documents.select("text").mapInArrow(lambda it: _counters(k)(it), "chunk int, way int, data binary")
    parts = documents.rdd.getNumPartitions()
    while parts > 1:  # a tree: each level leaves a FAN_IN-th of the parts
        rows, parts = _added(rows), -(-parts // FAN_IN)
    total = rows.collect()  # CHUNKS rows at most
    n = np.zeros(1 << SKETCH_BITS, np.uint32)
    size = len(n) // CHUNKS
    for r in total:
        n[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(zlib.decompress(r.data), np.uint32)
    return np.minimum(4 * np.log2(1 + n.astype(np.float64)), 255).astype(np.uint8)


def _features(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    for part in pieces(batch, "text"):
        s = _sets(column(part, "text"), k)
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(s.counts, pa.int64()), *map(pa.array, _keys(s, k))], ["doc_id", "n", "k1", "k2"])


def _prefixes(batch: pa.RecordBatch, k: int, percent: int, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each text that can link to a different one: its keys, minimum hashes, centrality and first tokens."""
    for part in pieces(batch, "text"):
        s = _sets(column(part, "text"), k)
        hashes, counts, doc = s.hash, s.counts, s.doc
        k1, k2 = _keys(s, k)
        stars = np.stack([_over(np.minimum, tv.mix(hashes ^ tv.U(r + 1)), counts, 0) for r in range(STARS)], axis=1).reshape(-1)
        kind = classes[hashes >> tv.U(64 - SKETCH_BITS)]
        order = np.lexsort((hashes, kind, doc))
        central = 1000 * np.bincount(doc, weights=kind, minlength=len(counts)) / np.maximum(counts, 1)
        need = -(-percent * counts // 100)
        size = np.minimum(counts - need + LEAST, counts)
        keep = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) < size[doc]
        rows = pa.RecordBatch.from_arrays(
            [column(part, "doc_id"), pa.array(counts, pa.int64()), pa.array(k1), pa.array(k2), ragged(stars.view(np.int64), np.full(len(counts), STARS), pa.int64()), pa.array(central.astype(np.int64)), ragged(hashes[order][keep].view(np.int64), size, pa.int64())],
            ["doc_id", "n", "k1", "k2", "stars", "central", "prefix"],
        )
        yield rows.filter(pa.array(100 * counts >= percent * (counts + 1)))


def _pair_sets(batch: pa.RecordBatch, k: int, percent: int) -> np.ndarray:
    """Which pairs of texts link."""
    a, b = _sets(column(batch, "text_a"), k), _sets(column(batch, "text_b"), k)
    doc = np.concatenate([a.doc, b.doc])
    hashed, word = np.concatenate([a.hash, b.hash]), np.concatenate([a.word, b.word])
    order = np.lexsort((hashed, doc))  # stable: of two equal hashes the first is of a
    doc, hashed, word = doc[order], hashed[order], word[order]
    both = np.flatnonzero((doc[1:] == doc[:-1]) & (hashed[1:] == hashed[:-1]))
    same = np.bincount(doc[both], minlength=batch.num_rows)
    out = 100 * same >= percent * (a.counts + b.counts - same)
    x, y = a.words, b.words
    size = np.minimum(x.counts, k)[doc[both]]
    out &= (a.counts > 0) & (b.counts > 0) & (np.minimum(x.counts, k) == np.minimum(y.counts, k))  # shingles of other sizes differ
    differ = np.zeros(batch.num_rows, bool)
    for i in range(k):
        at = np.flatnonzero((size > i) & out[doc[both]])
        p, q = word[both[at]] + i, word[both[at] + 1] + i
        wrong = ~tv.same_spans(x.data, x.start[p], x.end[p], y.data, y.start[q], y.end[q])
        differ[doc[both[at[wrong]]]] = True
    for d in np.flatnonzero(differ).tolist():  # words that differ and share a hash: this pair is compared by its words
        one, two = (_shingles(s.words, d, k) for s in (a, b))
        out[d] = 100 * len(one & two) >= percent * len(one | two)
    return out


def _shingles(w: tv.Words, d: int, k: int) -> set[tuple[bytes, ...]]:
    at, n = int(w.first[d]), int(w.counts[d])
    words = [w.data[w.start[i] : w.end[i]].tobytes() for i in range(at, at + n)]
    return {tuple(words[i : i + k]) for i in range(max(n - k + 1, 1))} if n else set()


def _linked(batch: pa.RecordBatch, k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of texts whose sets link."""
    for part in pieces(batch, "text_a"):
        for some in pieces(part, "text_b"):
            yield some.select(["a", "b"]).filter(pa.array(_pair_sets(some, k, percent)))


def verified(documents: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of pairs (a, b: doc_id) whose texts link, as u, v. A document with many partners is dealt to several tasks."""
    pairs = cut(pairs.distinct())
    ids = cut(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    texts = cut(documents.select("doc_id", "text").join(small_side(ids, ids.count(), 16), "doc_id"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    both = salted_join(salted_join(pairs, left, "a"), right, "b", counted=pairs)
    found = arrow_map(both.select("a", "b", "text_a", "text_b"), lambda x: _linked(x, k, percent), f"a {kind}, b {kind}")
    return found.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _sizes_fit(a: str, b: str, percent: int):
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _star_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """Each node with the most central node of each of its minimum hashes, where sizes allow a link."""
    keyed = nodes.select("doc_id", "n", "central", F.posexplode("stars").alias("r", "key"))
    pivots = keyed.groupBy("r", "key").agg(F.max(F.struct("central", F.col("n").alias("pivot_n"), F.col("doc_id").alias("pivot"))).alias("p"), F.count("*").alias("members")).where("members > 1").select("r", "key", "p.pivot", "p.pivot_n")
    return salted_join(keyed, pivots, "r", "key").where((F.col("doc_id") != F.col("pivot")) & _sizes_fit("n", "pivot_n", percent)).select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()


def _meetings(nodes: DataFrame, percent: int) -> DataFrame:
    """Queries with the groups that qualify; nodes: doc_id, n, grp, prefix. Returns a, grp, g, m (the members' set size), most.

    Sets of sizes n and m link if they share alike = ceil(percent * (n + m) / (100 + percent)) shingles or more. Then they
    share LEAST within the first n - alike + LEAST of one and m - alike + LEAST of the other. most bounds their overlap.
    """
    rows = nodes.select("doc_id", "n", "grp", F.posexplode("prefix").alias("pos", "token"))
    shared = rows.groupBy("token").agg(F.min("grp").alias("g1"), F.max("grp").alias("g2")).where("g1 <> g2").select("token")
    rows = cut(rows.join(shared, "token"))  # one row a token on the other side: Spark splits a token of many rows
    matrix = rows.groupBy("token", F.col("grp").alias("g"), F.col("n").alias("m")).agg(F.min("pos").alias("g_pos"))
    alike = F.expr(f"({percent} * (n + m) + {99 + percent}) div {100 + percent}")
    near = (F.col("pos") < F.col("n") - alike + LEAST) & (F.col("g_pos") < F.col("m") - alike + LEAST)
    met = salted_join(rows, matrix, "token").where((F.col("grp") > F.col("g")) & _sizes_fit("n", "m", percent) & near)
    found = met.groupBy("doc_id", "n", "grp", "g", "m").agg(F.count("*").alias("shared"), F.min("pos").alias("first"), F.min("g_pos").alias("g_first"))
    most = F.least(F.col("n") - F.col("first"), F.col("m") - F.col("g_first"))
    return found.where((F.col("shared") >= F.least(F.lit(LEAST), alike)) & (most >= alike)).select(F.col("doc_id").alias("a"), "grp", "g", "m", most.alias("most"))


def _opened(docs: DataFrame, nodes: DataFrame, meetings: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) between members of different groups, one at least for each pair of groups that has any.

    Where all pairs of queries and members are no more than EACH times the nodes, they are compared at once. Else a
    member's round is told by its hash and its group's number of members of its size: MORE**r of them, about, are in the
    rounds up to r. Pairs of groups that a round links drop out of the next ones; all others go on until every pair of
    a query and a member was compared.
    """
    kind = nodes.schema["doc_id"].dataType.simpleString()
    links = nodes.select(F.col("doc_id").alias("u"), F.col("doc_id").alias("v")).limit(0)
    left = cut(meetings)
    if left.isEmpty():
        return links
    members = nodes.select("doc_id", F.col("grp").alias("g"), F.col("n").alias("m"))
    sizes = cut(members.groupBy("g", "m").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("b"))).alias("one")).select("g", "m", "c", "one.b"))
    pairs = left.groupBy("g", "m").agg(F.count("*").alias("q")).join(sizes, ["g", "m"]).agg(F.sum(F.col("q") * F.col("c").cast("decimal(38,0)"))).head()[0]
    if pairs <= EACH * nodes.count():
        return verified(docs, salted_join(left, members.withColumnRenamed("doc_id", "b"), "g", "m").select("a", "b"), k, percent)
    best = F.max(F.struct("most", "m", "a")).alias("x")
    for by in (["grp", "g"], ["a", "grp", "g"]):
        found = left.groupBy(*by).agg(best).select("grp", "g", "x.a", "x.m")
        left, links = _round(docs, salted_join(found, sizes.select("g", "m", "b"), "g", "m"), left, links, k, percent)
    chance = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
    several = sizes.where("c > 1").select("g", "m", "c")
    level = F.greatest(F.ceil(F.log(F.col("c") * chance) / math.log(MORE)), F.lit(1)).cast("int")
    ranked = cut(salted_join(members, several, "g", "m").select("g", "m", F.col("doc_id").alias("b"), level.alias("level")))
    last = ranked.agg(F.max("level")).head()[0] or 0
    alone = sizes.where("c = 1").select("g", "m", "b", F.lit(1).alias("level"))
    for r in range(1, max(last, 1) + 1):
        if left.isEmpty():
            break
        now = ranked.where(F.col("level") == r)
        left, links = _round(docs, salted_join(left.select("a", "grp", "g", "m"), (now.unionByName(alone) if r == 1 else now).select("g", "m", F.col("b").cast(kind)), "g", "m"), left, links, k, percent)
    return links


def _round(docs: DataFrame, met: DataFrame, left: DataFrame, links: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(what is left of the meetings once pairs of met (a, b, grp, g) are compared, links and the new ones)."""
    met = cut(met.select("a", "b", "grp", "g"))
    new = cut(verified(docs, met.select("a", "b"), k, percent))
    if new.isEmpty():
        return left, links
    done = cut(met.join(new, (F.col("a") == F.col("u")) & (F.col("b") == F.col("v"))).select("grp", "g").distinct())
    return cut(left.join(small_side(done, done.count(), 32), ["grp", "g"], "left_anti")), links.unionByName(new)


def similar_groups(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of documents (doc_id, text; other columns are ignored).

    Texts are lower-cased in A-Z and cut into words at ASCII blanks; a set holds their distinct k-word shingles, or
    all words as one shingle if there are fewer. Documents link when 100 * intersection >= percent * union;
    component_id is the least doc_id that links reach. Null or empty texts and texts without words have an empty
    set and link with nothing. Rows that share a doc_id are one document with several texts; a null doc_id takes
    part in nothing and has a null component. Texts are compared by their words before they are linked; equal sets
    are told by 128 bits.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", "text")
    features = cut(arrow_map(docs, lambda b: _features(b, k), f"doc_id {kind}, n bigint, k1 bigint, k2 bigint"))
    classes = docs.sparkSession.sparkContext.broadcast(token_classes(docs, k))
    nodes = cut(features.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("node")))
    prefixes = arrow_map(docs, lambda b: _prefixes(b, k, percent, classes.value), f"doc_id {kind}, n bigint, k1 bigint, k2 bigint, stars array<bigint>, central bigint, prefix array<bigint>")
    one = small_side(nodes.withColumnRenamed("node", "doc_id"), nodes.count(), 96)
    rows = cut(prefixes.join(one, ["n", "k1", "k2", "doc_id"]).dropDuplicates(["n", "k1", "k2", "doc_id"]))
    stars = cut(verified(docs, _star_pairs(rows, percent), k, percent))
    groups = cut(components(stars))
    grouped = cut(rows.join(groups, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("grp"), "prefix"))
    links = _opened(docs, grouped, _meetings(grouped, percent), k, percent)
    mapped = cut(features.join(nodes, ["n", "k1", "k2"], "left").select("doc_id", "n", F.coalesce("node", "doc_id").alias("node")))
    several = mapped.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id")
    own = mapped.join(several, "doc_id").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    final = components(stars.unionByName(links).unionByName(own))
    return mapped.join(final, F.col("node") == F.col("id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents, with all their columns, whose doc_id is the least of its component.

    Rows with a null doc_id stay; of rows that share a doc_id one stays.
    """
    labels = cut(similar_groups(documents, k, percent))
    out = cut(labels.where("doc_id <> component_id").select("doc_id").distinct())
    columns = [F.col(f"`{c}`") for c in documents.columns]
    kept = documents.join(small_side(out, out.count(), 32), "doc_id", "left_anti").select(columns)
    again = cut(labels.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    if again.isEmpty():
        return kept
    once = small_side(again, again.count(), 32)
    return kept.join(once, "doc_id", "left_anti").unionByName(kept.join(once, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(columns)
