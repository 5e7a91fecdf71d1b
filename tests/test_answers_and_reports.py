import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from evigrain.operators import structured
from evigrain.plans import answers, service


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(f"c{i}", f"f{i % 3}", f"T{i % 3}", "A", "Li", 2020, i, i + i % 2, f"text {i}", [1.0, i / 10.0]) for i in range(9)]
    return spark.createDataFrame(rows, "chunk_id string, file_name string, title string, author string, teacher string, year int, page_start int, page_end int, text string, embedding array<double>")


def test_answers(spark, chunks):
    q = spark.createDataFrame([("q1", "什么是灵敏度？"), ("q2", "李老师主要研究什么？")], "question_id string, question string")
    texts = answers.retrieval_texts(q, chunks.select("file_name", "teacher", "title").distinct())
    got = {r.question_id: r for r in texts.collect()}
    assert not got["q1"].overview and got["q2"].overview and got["q2"].query.endswith("教师：Li。 论文主题：T0；T1；T2")
    asked = texts.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    found = answers.retrieve(chunks, asked, 3)
    ranks = {}
    for r in found.orderBy("question_id", "rank").collect():
        ranks.setdefault(r.question_id, []).append(r.chunk_id)
    assert ranks == {"q1": ["c0", "c1", "c2"], "q2": ["c0", "c1", "c2"]}
    far = answers.retrieve(chunks, asked.withColumn("embedding", F.array(F.lit(0.0), F.lit(1.0))), 3)
    assert sorted(r.chunk_id for r in far.where("question_id = 'q2'").collect()) == ["c6", "c7", "c8"]
    p = answers.prompts(found, chunks, q)
    one = p.where("question_id = 'q1'").first()
    assert one.source_count == 3 and "[资料 1]" in one.prompt and one.sources[1] == "[2] 《T1》，第 1-2 页，作者：A，Chunk：c1"
    ok = answers.answer(p, lambda df: df.withColumn("answer", F.lit("see [1] and [3]")))
    assert ok.count() == 2
    with pytest.raises(ValueError):
        answers.answer(p, lambda df: df.withColumn("answer", F.lit("see [4]")))


def test_extractions(spark):
    good = {"research_problem": " a  b ", "materials": ["m", "m"], "evidence_map": [{"field": "research_problem", "claim": "a b", "source_labels": ["S01"]}, {"field": "materials", "claim": "m", "source_labels": ["S02", "S01"]}]}
    bad = [
        "no json",
        json.dumps(good | {"methods": ["x"]}),
        json.dumps(good | {"materials": []}),
        json.dumps(good | {"evidence_map": good["evidence_map"][:1] + [{"field": "materials", "claim": "m", "source_labels": ["S09"]}]}),
        json.dumps(good | {"evidence_map": good["evidence_map"][:1] + [{"field": "materials", "claim": "m", "source_labels": []}]}),
    ]
    rows = [(i, "```json\n" + json.dumps(good) + "\n```" if i == 0 else bad[i - 1], ["S01", "S02"]) for i in range(6)]
    got = structured.parse_extractions(spark.createDataFrame(rows, "paper_id int, answer string, labels array<string>")).persist()
    assert [r.problem for r in got.orderBy("paper_id").collect()] == [None, "no JSON object", "a claim without evidence", "evidence for no claim", "an unknown label", "evidence without labels"]
    e = spark.createDataFrame([(0, "S01", "c1", 1, 2), (0, "S02", "c2", 3, 3)], "paper_id int, source_label string, chunk_id string, page_start int, page_end int")
    s = {r.field: [x.chunk_id for x in r.sources] for r in structured.resolve_sources(got, e).collect()}
    assert s == {"research_problem": ["c1"], "materials": ["c1", "c2"]}


def test_claims_of_a_reading(spark):
    df = spark.createDataFrame([([(" a ", ["E1"]), ("", [])], ["E1"])], "c array<struct<claim:string,source_labels:array<string>>>, l array<string>")
    assert [x.claim for x in df.select(structured.valid_claims(F.col("c"), F.col("l")).alias("v")).first().v] == ["a"]
    with pytest.raises(Exception, match="known label"):
        df.select(structured.valid_claims(F.col("c"), F.array(F.lit("E2"))).alias("v")).collect()


def test_edits(spark):
    m = ("TM01", "成本", "<=", "1", "", "c", "raw one")
    schema = "need_id string, industry string, product string, technical_problems array<string>, required_capabilities array<string>, constraints array<string>, existing_foundations array<string>, excluded_approaches array<string>, keywords array<string>, target_metrics array<struct<metric_id:string,name:string,operator:string,value_text:string,unit:string,test_condition:string,raw_text:string>>, evidence_map array<struct<field:string,value:string,phrases:array<string>>>"
    p = spark.createDataFrame([("n", "i", "p", [], ["k"], [], [], [], [], [m], [("required_capabilities", "k", ["orig"])])], schema)
    es = "need_id string, industry string, product string, technical_problems array<string>, required_capabilities array<string>, constraints array<string>, existing_foundations array<string>, excluded_approaches array<string>, keywords array<string>, metrics array<struct<name:string,operator:string,value_text:string,unit:string,test_condition:string>>"
    e = lambda *ms: spark.createDataFrame([("n", " ", "q", [], ["k", "K ", " new"], [], [], [], [], list(ms))], es)
    r = structured.apply_edits(p, e(("成本", "<=", "1", "", "c"), ("面积", ">=", "2", "m", ""), ("", "", "", "", ""))).first()
    assert (r.industry, r.product, r.required_capabilities) == ("未明确", "q", ["k", "new"])
    assert [(x.raw_text, x.provenance_type) for x in r.target_metrics] == [("raw one", "enterprise_original"), ("面积 >= 2 m", "enterprise_user_edit")]
    assert {(x.field, x.value): x.phrases for x in r.evidence_map}[("required_capabilities", "k")] == ["orig"] and len(r.evidence_map) == 5
    with pytest.raises(Exception, match="a metric needs"):
        structured.apply_edits(p, e(("面积", "?", "2", "m", ""))).collect()


def test_reports_and_packages(spark):
    papers = spark.createDataFrame([("p", "Title"), ("q", "None")], "paper_id string, title string")
    chosen = spark.createDataFrame([("p", "结论、局限与展望", 1, "c1")], "paper_id string, section string, place int, chunk_id string")
    chunks = spark.createDataFrame([("c1", "the end", 3, 4)], "chunk_id string, text string, page_start int, page_end int")
    got = {r.paper_id: r.report for r in structured.reading_reports(papers, chosen, chunks).collect()}
    assert "> the end\n\n第 3-4 页；`c1`" in got["p"] and got["p"].count("待人工核对。") == 4 and got["q"].count("待人工核对。") == 5
    z = structured.report_package({"b.md": b"x", "a.json": b"{}"})
    assert zipfile.ZipFile(io.BytesIO(z)).namelist() == ["a.json", "b.md"] and z == structured.report_package({"a.json": b"{}", "b.md": b"x"})


def test_service(spark):
    papers = spark.createDataFrame([(f"p{i}", f"t{i:02d}", "f.pdf", "Li" if i % 2 else "", ["a"], ["k"], "x", "parsed" if i < 3 else "failed", 2020) for i in range(25)], "paper_id string, title string, file_name string, teacher string, authors array<string>, keywords array<string>, direction string, ingestion_status string, year int")
    tags = spark.createDataFrame([("p1", "device", "radar", "radar", 0.5, "suggested"), ("p1", "author", "me", "me", 1.0, "confirmed"), ("p1", "material", "M", "m", 0.1, "confirmed"), ("p2", "device", "radar", "radar", 0.5, "rejected")], "paper_id string, category string, value string, normalized_value string, confidence double, review_status string")
    assert service.health(papers)["papers"] == 25
    assert service.stats(papers) == {"papers": 25, "parsed": 3, "owners": 1, "status_counts": {"parsed": 3, "failed": 22}}
    t = service.teachers(papers, tags)
    assert t["items"] == [{"teacher": "Li", "papers": 12}] and t["total"] == 2
    page = service.paper_page(papers, tags, teacher="Li", page=9, size=10)
    assert (page["page"], page["pages"], page["total"]) == (2, 2, 12) and [i["paper_id"] for i in page["items"]] == ["p21", "p23"]
    assert service.paper_page(papers, tags, query="radar")["items"][0]["tags"] == ["M", "radar"]
    assert service.paper_detail(papers, tags, "p1")["tags"] == ["M", "radar"]
    with pytest.raises(KeyError):
        service.paper_detail(papers, tags, "none")
