import pytest
from pyspark.sql import functions as F

from evigrain.functions import text as tx
from evigrain.functions import vectors as vx
from evigrain.operators import evidence, layout
from evigrain.sources.ontology import unit_key


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("x")).first()["x"]


def test_tokens_of_mixed_text(spark):
    t = lambda s: one(spark, tx.tokens(F.col("t")), t=s)
    assert t("A-Scan, v1.2 of X/Y_z!") == ["a-scan", "v1.2", "of", "x/y_z"]
    assert t("钙钛矿x射线") == ["钙", "钛", "矿", "钙钛", "钛矿", "x", "射", "线", "射线"]
    assert t("") == [] and t("矿") == ["矿"]
    assert t("Ｘ射ＡＢｃ Straße ﬁne É") == ["x", "射", "abc", "strasse", "fine"]


def test_folding(spark):
    assert one(spark, tx.fold(F.col("t")), t="Ｘ射線 Straße") == "x射線 strasse"
    assert one(spark, tx.fold(F.col("t")), t="Plain TEXT") == "plain text"


def test_units(spark):
    for raw, key in [("μC Gy_air^{-1} cm^{-2}", "ucgyair^-1cm^-2"), ("nGyₐᵢᵣs^{-1}", "ngyairs^-1"), ("cm²/V", "cm^2/v"), ("cm⁻³", "cm^-3"), ("µm", "um"), ("kΩ", "kohm")]:
        assert one(spark, tx.unit_key(F.col("t")), t=raw) == key == unit_key(raw)


def test_sentences_citations_json(spark):
    assert one(spark, tx.sentences(F.col("t")), t="甲。 乙  丙；丁!") == ["甲。", "乙 丙；", "丁!"]
    assert one(spark, tx.bad_citations(F.col("t"), F.lit(2)), t="a [1] [3] [0] [3]") == [0, 3]
    assert one(spark, tx.json_object(F.col("t")), t=' ```json\n{"a": {"b": 1}}\n``` ') == '{"a": {"b": 1}}' == one(spark, tx.json_object(F.col("t")), t='\n{"a": {"b": 1}}')
    for bad in ('x ```json\n{"a": 1}\n``` y', 'so: {"a": 1}', "[1]", "{oops", '"{}"'):
        assert one(spark, tx.json_object(F.col("t")), t=bad) is None
    assert one(spark, tx.json_object(F.col("t")), t="nothing") is None
    assert one(spark, tx.compact(F.col("t"), 10), t="abc  def") == "abc def"
    assert one(spark, tx.compact(F.col("t"), 10), t="abcdefg. hijklmn") == "abcdefg.……"


def test_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(vx.cosine(F.col("a"), F.col("b"))).collect()] == [0.96, None, None]
    bands = spark.createDataFrame([(None,), (39.0,), (40.0,), (60.0,), (80.0,)], "s double").select(vx.band(F.col("s")).alias("b")).collect()
    assert [r.b for r in bands] == ["未知", "低", "中低", "中", "较高"]
    assert one(spark, vx.to_step(F.col("s")), s=62.5) == 60.0


def test_sections_headings_blocks(spark):
    kind = lambda path, text: one(spark, layout.section_type(F.col("p"), F.col("t")), p=path, t=text)
    assert tuple(kind("2 实验部分", "x")) == ("experiment", "heading_rule")
    assert tuple(kind(layout.UNKNOWN_PATH, "本文摘要")) == ("abstract", "content_rule")
    assert tuple(kind("第一章 绪论", "1.1 背景........3")) == ("contents", "content_rule")
    assert tuple(kind(layout.UNKNOWN_PATH, "plain")) == ("unknown", "unknown")
    assert one(spark, layout.is_heading(F.col("t")), t="第三章 器件") and one(spark, layout.is_heading(F.col("t")), t="2.1 Setup") and not one(spark, layout.is_heading(F.col("t")), t="plain text")
    assert one(spark, layout.heading_level(F.col("t")), t="2.1.3 Setup") == 3 and one(spark, layout.heading_level(F.col("t")), t="摘要") == 1
    assert one(spark, layout.block_type(F.col("t")), t="图 3 结构") == "figure_caption" and one(spark, layout.block_type(F.col("t")), t="Table 2 x") == "table_caption"


def test_scripts_and_lines(spark):
    spans = [("l", 1, "10", 10.0, 0.0, 10.0, 100.0), ("l", 2, "-3", 6.0, 10.0, 14.0, 96.0), ("l", 3, "cm", 10.0, 20.0, 30.0, 100.0), ("l", 4, "2", 6.0, 30.0, 33.0, 102.0), ("m", 1, "alone", 7.0, 0.0, 9.0, 50.0)]
    df = spark.createDataFrame(spans, "line string, n int, text string, size double, x0 double, x1 double, y double")
    got = {r.line: (r.text, r.scripts) for r in layout.render_lines(df, ["line"], "n").collect()}
    assert got == {"l": ("10^{-3} cm_{2}", 2), "m": ("alone", 0)}


def test_running_heads_go(spark):
    rows = [("d", p, f"Journal {p}", [0.0, 10.0, 1.0, 20.0], 1000.0) for p in range(1, 5)] + [("d", p, f"body {p}", [0.0, 500.0, 1.0, 520.0], 1000.0) for p in range(1, 5)]
    df = spark.createDataFrame(rows, "doc_id string, page int, text string, bbox array<double>, page_height double")
    assert sorted(r.text for r in layout.drop_running_heads(df).collect()) == [f"body {p}" for p in range(1, 5)]


def test_split_long():
    assert layout.split_long("short") == ["short"]
    text = "a" * 300 + "。" + "b" * 400
    pieces = layout.split_long(text)
    assert pieces[0] == "a" * 300 + "。" and pieces[1].startswith("a" * 79 + "。b") and all(len(p) <= 450 for p in pieces)
    assert pieces[-1].endswith("b")


def test_chunks_follow_the_outline(spark):
    toc = [(1, "绪论", 1), (1, "实验部分", 2)]
    pages = [
        (1, "", [(1, "paragraph", "绪论"), (2, "paragraph", "甲" * 200), (3, "paragraph", "乙" * 200), (4, "paragraph", "丙" * 200)]),
        (2, "", [(1, "paragraph", "实验部分"), (2, "figure_caption", "图 1 装置"), (3, "paragraph", "丁" * 20)]),
    ]
    schema = "file_name string, toc array<struct<level:int,title:string,page:int>>, pages array<struct<page:int,text:string,blocks:array<struct<block_number:int,block_type:string,text:string>>>>"
    df = spark.createDataFrame([("p.pdf", toc, pages), ("empty.pdf", [], []), ("plain.pdf", None, [(1, "1 Intro\n", None)])], schema)
    got = [r for r in layout.chunk_documents(df).collect() if r.file_name == "p.pdf"]
    assert [(r.chunk_id, r.section_path, r.section_type, len(r.text), r.block_start, r.block_end) for r in got] == [
        ("p_chunk_0001", "绪论", "intro", 401, 2, 3),
        ("p_chunk_0002", "绪论", "intro", 200, 4, 4),
        ("p_chunk_0003", "实验部分", "experiment", 6, 2, 2),
        ("p_chunk_0004", "实验部分", "experiment", 20, 3, 3),
    ]
    with pytest.raises(ValueError):
        layout.chunk_documents(df, 10, 10)


def test_nearest_image(spark):
    c = spark.createDataFrame([("c1", "d", 1, 100.0, 400.0, 300.0, 420.0, 1000.0), ("c2", "d", 2, 0.0, 0.0, 10.0, 10.0, 1000.0)], "caption_id string, doc_id string, page int, x0 double, y0 double, x1 double, y1 double, page_height double")
    i = spark.createDataFrame([("near", "d", 1, 100.0, 200.0, 300.0, 390.0), ("far", "d", 1, 100.0, 0.0, 300.0, 100.0), ("small", "d", 1, 100.0, 390.0, 120.0, 399.0), ("below", "d", 1, 100.0, 500.0, 300.0, 700.0)], "image_id string, doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert {r.caption_id: r.image_id for r in layout.nearest_images(c, i).collect()} == {"c1": "near", "c2": None}


def test_evidence_choices(spark):
    why = lambda t: one(spark, evidence.rejection_reason(F.col("t")), t=t)
    assert why("见 参考文献") == "参考文献" and why("a ...... 3") == "目录点线" and why("[1] a [2] b [ 3 ] c") == "参考文献格式" and why("fine") is None
    rows = [("p", "a1", "abstract", "", "摘要" + "x" * 60, 1), ("p", "m1", "method", "", "y" * 60, 5), ("p", "m2", "unknown", "", "实验方案" + "z" * 60, 6), ("p", "r1", "reference", "", "结论" + "z" * 60, 9), ("p", "u", "unknown", "", "展望" + "z" * 60, 2)]
    df = spark.createDataFrame(rows, "paper_id string, chunk_id string, section_type string, section_path string, text string, page_start int")
    got = {(r.section, r.place): r.chunk_id for r in evidence.reading_evidence(df).collect()}
    assert got == {("摘要与研究目标", 1): "a1", ("方法与技术路线", 1): "m1", ("方法与技术路线", 2): "m2"}
    pages = spark.createDataFrame([("f", 1, 30, "x"), ("f", 20, 22, "参考文献 [1] y"), ("g", 1, 4, "z")], "file_name string, page_start int, page_end int, text string")
    assert {r.file_name: r.end_page for r in evidence.main_text_end(pages).collect()} == {"f": 22, "g": 5}
    blocks = spark.createDataFrame([("d", 1, 1, "before"), ("d", 1, 2, "E = mc (2.1)"), ("d", 1, 3, "after one"), ("d", 1, 4, "a = b"), ("d", 2, 1, "no formula")], "doc_id string, page int, block_number int, text string")
    f = evidence.formula_blocks(blocks).collect()
    assert [(r.source_label, r.page, r.score, r.context) for r in f] == [("Q01", 1, 9, "before after one")]


def test_captions_and_joined_lines(spark):
    cap = lambda t: one(spark, layout.caption_parts(F.col("t")), t=t)
    assert tuple(cap("图 2-1： 器件结构.")) == ("figure", "图2-1", "器件结构")
    assert tuple(cap("Table 3")) == ("table", "Table3", "Table 3") and tuple(cap("Fig. 4 x")) == ("figure", "Fig4", "x")
    assert cap("plain") is None
    assert one(spark, layout.join_lines(F.col("t")), t=["a^{1", "", "b"]) == "a^{1\nb"
    assert one(spark, layout.join_lines(F.col("t")), t=["x^{-", " ", "y"]) == "x^{-\ny"
    assert one(spark, layout.join_lines(F.col("t")), t=["cm^{-}", "^{2} s", "_{a}", "^{b}"]) == "cm^{-2} s\n_{a}\n^{b}"


def test_summaries(spark):
    c = spark.createDataFrame([("f", "abc"), ("f", "a")], "file_name string, text string")
    assert tuple(layout.chunk_summary(c, ["file_name"]).first()) == ("f", 4, 2, 2.0)
    b = spark.createDataFrame([("f", 1, "paragraph", 2), ("f", 2, "figure_caption", 0)], "file_name string, page int, block_type string, script_span_count int")
    assert tuple(layout.layout_audit(b, ["file_name"]).first()) == ("f", 2, 2, 1, 0, 2)


def test_nearest_images_of_crowded_pages(spark):
    """Random boxes, many on one page, against all pairs."""
    import numpy as np

    rng = np.random.default_rng(4)
    box = lambda w, h: (lambda x, y: (x, y, x + w, y + h))(float(rng.uniform(-50, 600)), float(rng.uniform(-50, 900)))
    captions = [(f"c{k}", "d", int(k % 5 == 0), *box(float(rng.uniform(20, 500)), 20.0), 842.0) for k in range(120)]
    images = [(f"i{k:04d}", "d", int(k % 5 == 0), *box(float(rng.uniform(30, 600)), float(rng.uniform(30, 300)))) for k in range(400)]
    c = spark.createDataFrame(captions, "caption_id string, doc_id string, page int, x0 double, y0 double, x1 double, y1 double, page_height double")
    i = spark.createDataFrame(images, "image_id string, doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    want = {}
    for cid, _, page, x0, y0, x1, y1, height in captions:
        found = []
        for iid, _, p, a0, b0, a1, b1 in images:
            share = max(0.0, min(a1, x1) - max(a0, x0)) / max(1.0, min(a1 - a0, x1 - x0))
            gap = max(0.0, y0 - b1)
            if p == page and a1 - a0 >= 55 and b1 - b0 >= 45 and b1 <= y1 + 18 and share >= 0.12 and gap <= height * 0.42:
                found.append((gap, -(a1 - a0) * (b1 - b0), iid))
        want[cid] = min(found)[2] if found else None
    got = {r.caption_id: r.image_id for r in layout.nearest_images(c, i).collect()}
    assert got == want and any(want.values()) and not all(want.values())


def test_equal_boxes_meet_once(spark):
    """Many equal captions and images of a page give the rows that all pairs give, from joins of unlike boxes only."""
    c = spark.range(4000).select(F.col("id").alias("caption_id"), F.lit("d").alias("doc_id"), F.lit(1).alias("page"), (F.col("id") % 2 * 900.0).alias("x0"), F.lit(400.0).alias("y0"), (F.col("id") % 2 * 900.0 + 100).alias("x1"), F.lit(420.0).alias("y1"), F.lit(1000.0).alias("page_height"))
    i = spark.range(4000).select(F.col("id").alias("image_id"), F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.lit(0.0).alias("x0"), (F.col("id") % 3 * 40.0).alias("y0"), F.lit(200.0).alias("x1"), (F.col("id") % 3 * 40.0 + 200).alias("y1"))
    got = layout.nearest_images(c, i)
    rows = {r.caption_id: (r.image_id, r.gap) for r in got.collect()}
    assert len(rows) == 4000 and all(v == ((2, 120.0) if k % 2 == 0 else (None, None)) for k, v in rows.items())
    joined = got._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("Aggregate") >= 3 and "min(image_id" in joined


def test_documents_are_unfolded_some_at_a_time(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"file_name": str(k), "text": "x" * 1000} for k in range(10_000)])
    parts = list(layout._slices(batch))
    assert [r["file_name"] for part in parts for r in part] == [str(k) for k in range(10_000)]
    assert max(len(part) for part in parts) * batch.nbytes / 10_000 <= layout.UNFOLDED
    docs = spark.range(50).coalesce(1).select(F.concat("id", F.lit(".pdf")).alias("file_name"), F.expr("array(named_struct('page', 1, 'text', 'body', 'blocks', cast(null as array<struct<block_number:int,block_type:string,text:string>>)))").alias("pages"), F.expr("cast(null as array<struct<level:int,title:string,page:int>>)").alias("toc"))
    got = layout.chunk_documents(docs)
    assert sorted(r.chunk_id for r in got.collect()) == sorted(f"{k}_chunk_0001" for k in range(50))
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
