import numpy as np
import pytest

import corpus_pipeline as c
from evigrain.llm import quality, toxicity
from evigrain.llm.common import materialize, read_table

from .test_jaccard import brute as near
from .test_lines import brute as lines
from .test_packing import check


def test_each_stage_on_its_own_input(spark, sf_dir):
    assert [n for n, _ in c.STAGES] == ["toxicity", "quality", "line_dedup", "jaccard_join", "packing"]
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    seen = {}
    for name, stage in c.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        model = {"toxicity": toxicity, "quality": quality}.get(name)
        said = model.score(docs, model.fit(docs, labels)).collect() if model else None
        out = materialize(stage(spark, docs, sf_dir), "test")
        if name != "packing":
            assert out.columns == docs.columns
            after = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
        if name == "toxicity":
            assert {d for d, _ in after} == {r.doc_id for r in said if not r.rejected}
        elif name == "quality":
            assert {d for d, _ in after} == {r.doc_id for r in said if r.predicted}
        elif name == "line_dedup":
            assert sorted(after, key=str) == lines(before)
        elif name == "jaccard_join":
            assert {d for d, _ in after} == {d for d, _, low in near(before) if d == low}
        else:
            check(out.collect(), dict(before))
        seen[name] = len(before)
        docs = out
    assert seen["quality"] < seen["toxicity"] and seen["packing"] < seen["jaccard_join"]
    assert sorted(map(tuple, c.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "start", "length", "ids_crc32").collect()))


CLASHING = ["k", "leaf", "line", "region", "digest", "n", "t", "y", "b", "component_id", "n_shingles", "length", "rank", "part", "_drop", "_id", "id"]


def small(spark, path, rows, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in CLASHING)
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), *CLASHING) for i, t in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = [f"{a}{b}ere" for a in "bcdfghjklm" for b in "aeiou"]
    text = lambda n: " ".join(rng.choice(words, n)) + "."
    same = text(40)
    rows = [(i, text(40) + (" vile rotten" if i % 10 == 0 else "")) for i in range(200)] + [(300, None), (301, ""), (302, "\n \n"), (303, same), (304, same), (304, same), (305, text(60_000)), (None, text(30))]
    rows += [(400 + k, f"{text(30)}\nAll rights are reserved by the owner\n{text(30)}") for k in range(8)]
    d = small(spark, tmp_path, rows, [(i, 1, int(i % 10 == 0)) for i in range(200)] + [(None, 1, 1), (5, None, None)])
    docs, kept = read_table(spark, d, "documents"), {}
    for name, stage in c.STAGES:
        docs = materialize(stage(spark, docs, d), "test")
        kept[name] = [r[0] for r in docs.select("doc_id").collect()]
        assert name == "packing" or docs.columns[-len(CLASHING) :] == CLASHING
    clean = {i for i, _ in rows} - set(range(0, 200, 10))
    assert set(kept["toxicity"]) == clean and sorted(kept["quality"], key=str) == sorted(kept["line_dedup"], key=str) == sorted(kept["toxicity"], key=str)
    assert {303, 300, 301, 302, 305, None} <= set(kept["jaccard_join"]) and 304 not in kept["jaccard_join"] and set(kept["packing"]) == clean - {304}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "one text")]])
def test_tiny_tables(spark, tmp_path, rows):
    d = small(spark, tmp_path, rows, [])
    assert {r.doc_id for r in c.run(spark, d).collect()} == {i for i, _ in rows}
