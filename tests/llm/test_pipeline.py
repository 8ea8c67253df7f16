"""Each stage of the pipeline on its own input, held against what its operator promises."""

from __future__ import annotations

import re

import corpus_pipeline as P
from quayline.llm.common import table
from quayline.llm.decontamination import decontaminate
from quayline.llm.quality import assess

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, kept = table(spark, SF, "documents"), []
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        assert i == len(P.STAGES) - 1 or out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(i)))
        kept.append((docs, out := spark.read.parquet(str(tmp_path / str(i)))))
        docs = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = kept[0]
    assert ids(after) == {r.doc_id for r in assess(before).where("kept").collect()}
    before, after = kept[1]
    assert ids(after) == ids(before) and all(r.n_chars == len(r.text) for r in after.collect())
    before, after = kept[2]
    grams = {r.doc_id: (lambda w: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())(re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())) for r in before.collect()}
    left = ids(after)
    link = lambda a, b: grams[a] and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])
    assert not any(link(a, b) for a in left for b in left if a < b)
    for gone in ids(before) - left:
        reach, todo = {gone}, [gone]
        while todo:
            x = todo.pop()
            new = {y for y in grams if y not in reach and link(x, y)}
            reach |= new
            todo += new
        assert min(reach) in left
    before, after = kept[3]
    bad = {r.doc_id for r in decontaminate(before, table(spark, SF, "benchmark")).where("contaminated").collect()}
    assert ids(after) == ids(before) - bad
    before, after = kept[4]
    rows = after.collect()
    assert ids(after) == ids(before) and all(r.round_trip for r in rows)
    assert len({(r.doc_id, r.sample) for r in rows}) == len(rows)


def test_run_on_awkward_rows(spark, tmp_path):
    """Nulls in any column, repeated rows and ids, empty and long texts, and further columns with names that operators use."""
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    plain = {i: f"{words(f'a{i}x', 40)}\n{words(f'b{i}x', 30)}" for i in range(8)}
    leak = words("leak", 15)
    rows = [(i, t, "en", "s", len(t)) for i, t in plain.items()]
    rows += [(0, plain[0], "en", "s", 1), (20, plain[1], "en", "s", 1), (None, words("a9x", 60), None, None, None), (21, None, "en", "s", None), (22, "", "en", "s", 0), (23, words("c", 30) + "\n" + leak + " " + words("d", 30), "en", "s", 5), (24, words("long", 30_000), "en", "s", 7)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _h string, grp string, n string, token string, gone string, seed string, place string"
    docs = spark.createDataFrame([(*r, *"abcdefg") for r in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak), (None, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = P.run(spark, str(tmp_path)).collect()
    assert all(r.round_trip for r in out)
    kept = {r.doc_id for r in out}
    assert {0, 1, 2, 3, 4, 5, 6, 7, None} <= kept and not kept & {21, 22, 23}
    assert {(r.doc_id, r.sample) for r in out if r.doc_id == 0} == {(0, k) for k in range(3)}
    for name, stage in P.STAGES[:-1]:
        some = stage(spark, docs, str(tmp_path))
        assert some.columns == docs.columns, name
        assert some.where("grp is null or token <> 'd'").count() == 0, name


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
