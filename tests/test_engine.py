import json

import pytest
from pyspark.sql import functions as F

from evigrain.operators import catalog, directions, matching, metrics, needs, profiles, retrieval, solutions
from evigrain.operators.evaluation import evaluate, run_rows
from evigrain.plans import filters, workflow
from evigrain.sources import files
from evigrain.sources.ontology import Directions, Ontology
from evigrain.streaming import ingest

ONTOLOGY = {
    "metrics": [
        {"metric_id": "thickness", "aliases": ["厚度", "thickness"], "canonical_unit": "μm", "directions": [], "units": [{"symbol": "μm", "aliases": ["um", "微米"], "scale": 1.0}, {"symbol": "nm", "aliases": [], "scale": 0.001}, {"symbol": "mm", "aliases": [], "scale": 1000.0}]},
        {"metric_id": "limit", "aliases": ["检测限", "LOD"], "canonical_unit": "nGy/s", "directions": ["x"], "units": [{"symbol": "nGy/s", "aliases": ["nGy s^-1"], "scale": 1.0}]},
    ]
}
TAXONOMY = {"directions": [{"direction_id": "x", "aliases": ["X-ray"], "keywords": ["X射线", "探测器"]}, {"direction_id": "y", "aliases": [], "keywords": ["天线", "雷达"]}]}


@pytest.fixture(scope="module")
def ontology():
    return Ontology.read(ONTOLOGY)


def test_metric_records(spark, ontology):
    rows = [
        ("c1", "p", "x", "results", "测试结果表明，在50 V偏压条件下，厚度为1,200 nm。厚度达到20–40 μm；Thickness 3 × 10^{2} nm!"),
        ("c2", "p", "x", "reference", "厚度 1200nm 和 厚度1.2μm。检测限低至 5 nGy/s，当剂量变化时。"),
        ("c3", "p", "y", "intro", "检测限为 9 nGy/s。thickness 5 mmol"),
        ("c4", "p", None, None, None),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, paper_id string, direction string, section_type string, text string")
    got = metrics.extract(df, ontology).collect()
    key = sorted((r.chunk_id, r.definition_id, r.value_type, round(r.normalized_min, 6), round(r.normalized_max, 6), r.operator, r.evidence_level, r.test_condition) for r in got)
    assert key == [
        ("c1", "thickness", "point", 0.3, 0.3, "=", "reported", ""),
        ("c1", "thickness", "point", 1.2, 1.2, "=", "measured", "50 V偏压"),
        ("c1", "thickness", "range", 20.0, 40.0, ">=", "reported", ""),
        ("c2", "limit", "point", 5.0, 5.0, "<=", "reported", "剂量变化"),
        ("c2", "thickness", "point", 1.2, 1.2, "=", "reported", ""),
    ]
    assert all(r.metric_id.startswith("MET-") and len(r.metric_id) == 20 for r in got) and len({r.metric_id for r in got}) == 5
    table = metrics.extract(df, ontology)
    assert metrics.invalid(table).count() == 0
    s = {r.chunk_id: r for r in metrics.summary(table, ["chunk_id"]).collect()}
    assert (s["c1"].metrics, s["c1"].measured, s["c1"].without_condition) == (3, 1, 2)
    assert metrics.comparable(table).count() == 0


def test_filter_contract(spark, ontology):
    known = {"x", "y"}
    f = filters.parse({"direction": "x", "section_types": ["results", "method"], "metrics": [{"definition_id": "thickness", "operator": "between", "value": 1, "upper_value": 2, "unit": "mm"}]}, ontology, known)
    assert f.metrics[0].target == 1000 and f.metrics[0].upper == 2000 and f.section_types == ("method", "results")
    m = {"definition_id": "thickness", "operator": "gte", "value": 1, "unit": "um"}
    for bad in ({"other": 1}, {"direction": "z"}, {"section_types": ["no"]}, {"metrics": [m | {"value": True}]}, {"metrics": [m | {"value": float("nan")}]}, {"metrics": [m | {"unit": "kg"}]}, {"metrics": [m | {"upper_value": 2}]}, {"metrics": [m | {"x": 1}]}, {"metrics": [m | {"evidence_levels": []}]}, {"metrics": [m | {"operator": "eq2"}]}):
        with pytest.raises(ValueError):
            filters.parse(bad, ontology, known)
    rec = [("a", "point", 12.0, None, None, "measured"), ("a", "range", None, 5.0, 20.0, "measured"), ("b", "point", 12.0, None, None, "inferred"), ("c", "range", None, 11.0, 30.0, "reported"), ("d", "point", None, None, None, "measured")]
    records = spark.createDataFrame([(c, "thickness", "μm", lv, "", t, v, lo, hi) for c, t, v, lo, hi, lv in rec], "chunk_id string, definition_id string, canonical_unit string, evidence_level string, test_condition string, value_type string, normalized_value double, normalized_min double, normalized_max double")
    hit = lambda *cs: sorted(r.chunk_id for r in filters.matching_chunks(records, tuple(filters._constraint(m | c, ontology) for c in cs)).collect())
    assert hit({"operator": "gte", "value": 11}) == ["a", "c"]
    assert hit({"operator": "eq", "value": 12}) == ["a", "c"]
    assert hit({"operator": "gte", "value": 11}, {"operator": "lte", "value": 20}) == ["a"]
    assert hit({"operator": "gte", "value": 11, "evidence_levels": ["inferred"]}) == ["b"]
    assert hit() == ["a", "b", "c", "d"]
    chunks = spark.createDataFrame([("a", "x", "results"), ("b", "x", "results"), ("c", "y", "results")], "chunk_id string, direction string, section_type string")
    p = filters.plan({"direction": "x", "metrics": [m | {"value": 11}]}, ontology, known, records)
    assert [r.chunk_id for r in p.apply(chunks).collect()] == ["a"] and not p.is_empty()
    assert filters.plan({"metrics": [m | {"value": 1e9}]}, ontology, known, records).is_empty()


def test_bad_configuration():
    broken = json.loads(json.dumps(ONTOLOGY))
    broken["metrics"][1]["metric_id"] = "thickness"
    with pytest.raises(ValueError):
        Ontology.read(broken)
    with pytest.raises(ValueError):
        Directions.read({"directions": [{"direction_id": "a", "aliases": ["q"], "keywords": []}, {"direction_id": "b", "aliases": ["Q"], "keywords": []}]})


def test_directions(spark):
    rows = [(1, "X-ray", "", ""), (2, "", "X射线探测器", "天线"), (3, "odd", "天线", "X射线探测器雷达"), (4, "", "雷达", "X射线 探测器 天线"), (5, None, "", "雷达")]
    df = spark.createDataFrame(rows, "id int, direction string, title string, body string")
    got = {r.id: (r.direction_id, r.direction_source, r.direction_confidence) for r in directions.classify(df, Directions.read(TAXONOMY), F.col("body")).collect()}
    assert got == {1: ("x", "metadata", 1.0), 2: ("x", "keyword_rule", 0.8571), 3: ("y", "keyword_rule", 0.6667), 4: ("y", "keyword_rule", 0.6667), 5: ("unclassified", "unclassified", 0.0)}
    model = lambda title, text: F.struct(F.lit("x").alias("direction_id"), F.lit(0.7).alias("confidence"))
    assert directions.classify(df.where("id = 5"), Directions.read(TAXONOMY), F.col("body"), model=model).first().direction_source == "model_fallback"


def test_qrels_and_runs(spark):
    q = spark.createDataFrame([("q1", "a", 2), ("q1", "a", 1), ("q1", "c", 1), ("q2", "d", 1), ("q3", "z", 0)], files.QREL)
    r = spark.createDataFrame([("q1", ["x", "a", "c", "a"]), ("q2", ["d", "z"])], files.RUN)
    got = {x.cutoff: x for x in evaluate(q, run_rows(r), (1, 2, 3)).collect()}
    assert [got[k].recall for k in (1, 2, 3)] == [0.5, 0.75, 1.0] and got[2].mrr == 0.75 and got[1].queries == 2


def test_hybrid_methods(spark):
    c = spark.createDataFrame([("a", "red fox", [1.0, 0.0]), ("b", "red red", [0.0, 1.0]), ("c", "", [0.7, 0.7]), ("d", None, None)], "chunk_id string, text string, embedding array<double>")
    q = spark.createDataFrame([("q", "red red fox", [1.0, 0.1])], "query_id string, query string, embedding array<double>")
    ids = lambda df: [r.chunk_id for r in df.orderBy("rank").collect()]
    assert ids(retrieval.hybrid_search(c, q, "bm25", 5)) == ["a", "b"]
    assert ids(retrieval.hybrid_search(c, q, "dense", 2)) == ["a", "c"]
    assert ids(retrieval.hybrid_search(c, q, "rrf", 3)) == ["a", "b", "c"]
    assert ids(retrieval.hybrid_search(c, q, "rerank", 3, scorer=lambda q, t: -F.length(t))) == ["c", "a", "b"]
    for bad in ({"method": "no"}, {"method": "dense", "k": 0}, {"method": "rrf", "k": 10, "candidates": 5}, {"method": "rerank"}):
        with pytest.raises(ValueError):
            retrieval.hybrid_search(c, q, **bad)


def test_catalog_changes(spark):
    papers = spark.createDataFrame([("p1", "B", "T", "parsing", "", "1", "1"), ("p2", "a", "T", "failed", "", "1", "1"), ("p3", "c", "U", "metadata_pending", "", "1", "1")], "paper_id string, title string, teacher string, ingestion_status string, error_message string, created_at string, updated_at string")
    assert {r.paper_id: r.ingestion_status for r in catalog.recover(papers).collect()} == {"p1": "metadata_pending", "p2": "failed", "p3": "metadata_pending"}
    assert [r.paper_id for r in catalog.candidates(papers, "metadata_pending", 5, True).collect()] == ["p3", "p2"]
    change = spark.createDataFrame([("p3", "parsed", None, "2")], "paper_id string, status string, error_message string, at string")
    assert {r.paper_id: (r.ingestion_status, r.updated_at) for r in catalog.set_status(papers, change).collect()}["p3"] == ("parsed", "2")
    with pytest.raises(Exception, match="unknown status"):
        catalog.set_status(papers, change.withColumn("status", F.lit("odd"))).collect()
    old = spark.createDataFrame([], "tag_id string, paper_id string, category string, value string, normalized_value string, source string, confidence double, review_status string, created_at string, updated_at string")
    new = spark.createDataFrame([("p1", "material", " New  Stuff ", "user", 0.5, "suggested", "1", "1")], "paper_id string, category string, value string, source string, confidence double, review_status string, created_at string, updated_at string")
    tags = catalog.upsert_tags(old, catalog.with_tag_ids(new), papers)
    again = catalog.upsert_tags(tags, catalog.with_tag_ids(new.withColumn("confidence", F.lit(0.9)).withColumn("created_at", F.lit("9")).withColumn("updated_at", F.lit("9"))), papers)
    r = again.collect()
    assert len(r) == 1 and (r[0].confidence, r[0].created_at, r[0].updated_at, r[0].normalized_value) == (0.9, "1", "9", "new stuff")
    assert catalog.review_tag(again, r[0].tag_id, "confirmed", "10").first().review_status == "confirmed"
    with pytest.raises(ValueError):
        catalog.upsert_tags(old, catalog.with_tag_ids(new.withColumn("paper_id", F.lit("no"))), papers)
    rules = [{"category": "device", "value": "radar", "keywords": ["radar", "rad"], "confidence": 0.97}]
    pages = spark.createDataFrame([("p1", 2, "a Radar"), ("p1", 5, "radar"), ("p2", 1, "none")], "paper_id string, page int, text string")
    assert [tuple(r) for r in catalog.content_tags(pages, rules).collect()] == [("p1", "device", "radar", "content_rule", 0.99, 2, "radar, rad")]


def test_wildcards_stay_live(spark):
    df = spark.createDataFrame([("a_b",), ("aXb",), ("a\\b",), ("ab",)], "t string")
    hit = lambda s: [r.t for r in df.where(catalog.like(F.col("t"), s)).collect()]
    assert hit("A_B") == ["a_b", "aXb", "a\\b"] and hit("a\\b") == ["a\\b"] and hit("a%b") == ["a_b", "aXb", "a\\b", "ab"]


REQUEST = "我们希望开发X 射线探伤设备，用于工业无损检测。要求高灵敏度、低成本；检测限不超过 5 nGy/s，在50 V偏压条件下测试。已有样机，不采用铅基材料。天气很好。"


def test_needs(spark):
    df = spark.createDataFrame([("n1", REQUEST), ("n2", "hello")], "need_id string, request_text string")
    got = {r.need_id: r for r in needs.parse(df).collect()}
    n = got["n1"]
    assert (n.industry, n.product) == ("工业检测", "X射线探伤设备")
    assert n.required_capabilities == ["高灵敏度X射线探测", "低成本材料"] and n.keywords[:1] == ["X射线"]
    m = n.target_metrics[0]
    assert (m.metric_id, m.name, m.operator, m.value_text, m.unit) == ("TM01", "检测限", "<=", "5", "nGy/s") and "50 V" in m.test_condition
    assert n.existing_foundations == ["已有样机"] and n.excluded_approaches == ["不采用铅基材料"]
    assert n.unparsed_fragments == ["天气很好"] or "天气很好" in n.unparsed_fragments
    assert (got["n2"].industry, got["n2"].product, got["n2"].required_capabilities) == ("未明确", "未明确", [])
    assert needs.invalid(needs.parse(df)).count() == 0
    empty = {r.need_id: (r.error, r.keywords, r.industry) for r in needs.parse(df.withColumn("request_text", F.when(F.col("need_id") == "n1", F.col("request_text")).when(F.col("need_id") == "n2", "  "))).collect()}
    assert empty["n1"][0] is None and empty["n2"] == ("an empty request", [], "未明确")


SRC = [("ch1", 1, 2)]


def records(spark):
    e = lambda f, c: (f, c, SRC)
    rows = [
        (("f1", "T1", "A", "Li", 2020), "prob", ["X射线探测"], ["高灵敏度 探测", "低成本 工艺"], ["工业检测"], [], [e("research_direction", "X射线探测"), e("core_technologies", "高灵敏度 探测"), e("core_technologies", "低成本 工艺"), e("applications", "工业检测")]),
        (("f2", "T2", "B", "Li", 2021), "prob", ["x 射线 探测"], [], [], ["柔性器件"], [e("research_direction", "x 射线 探测"), e("industry_potential", "柔性器件")]),
    ]
    return spark.createDataFrame(rows, files.CAPABILITY)


def test_profiles(spark):
    p = profiles.profiles(records(spark)).first()
    assert p.research_directions == ["X射线探测"] and p.core_capabilities == ["低成本 工艺", "高灵敏度 探测"]
    assert p.potential_industries == ["工业无损检测", "柔性电子与可穿戴设备"] and (p.paper_count, p.author_count, p.evidence_chunk_count) == (2, 2, 1)
    with pytest.raises(Exception, match="no source"):
        profiles.profiles(records(spark).withColumn("evidence_map", F.slice("evidence_map", 1, 1))).collect()


def test_workflow(spark):
    req = spark.createDataFrame([("n1", REQUEST, True), ("n2", REQUEST, False)], "need_id string, request_text string, confirmed boolean")
    people = profiles.profiles(records(spark))
    texts = [("ch1", "高灵敏度 X 射线 探测 工业 无损检测 低成本 探伤 设备", "Li"), ("ch2", "unrelated", "Wu")]
    chunks = workflow.hashed_vectors(spark.createDataFrame(texts, "chunk_id string, text string, teacher string"), "text", "embedding").withColumns({"page_start": F.lit(1), "page_end": F.lit(2)})
    state = workflow.run(req, people, chunks)
    t = state.tables
    assert [e["status"] for e in state.trace] == ["completed"] * 8
    m = {r.need_id: r for r in t["matches"].collect()}
    assert m["n1"].teacher == "Li" and 0 < m["n1"].score <= 100 and m["n1"].score == m["n2"].score
    assert matching.invalid(t["matches"]).count() == 0
    gate = {r.need_id: r.status for r in t["gate"].collect()}
    assert gate["n2"] == "blocked" and gate["n1"] in ("passed", "provisional")
    assert {r.need_id: r.decision for r in t["transfer"].collect()}["n2"] == "pause_for_confirmation"
    nodes = [r.node_id for r in t["nodes"].orderBy("node_id").collect()]
    assert nodes == ["R01", "R02", "R03", "R04", "R05"]
    edges = {(r.source, r.target) for r in t["edges"].collect()}
    assert edges == {("R01", "R02"), ("R01", "R03"), ("R02", "R04"), ("R03", "R04"), ("R04", "R05")}
    assert [r.milestone_id for r in t["landing_plan"].orderBy("milestone_id").collect()] == ["L01", "L02", "L03", "L04", "L05"]
    assert "R05" in solutions.drawio(t["nodes"], t["edges"], "n1")
    assert {r.need_id: (r.status, r.issues) for r in t["review"].collect()}["n1"] == ("passed", [])
    with pytest.raises(Exception, match="empty request"):
        workflow.run(req.withColumn("request_text", F.lit(" ")), people, chunks).tables["matches"].collect()


def test_single_module_route_and_cycles(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    s = spark.createDataFrame([("n", "M01", "only", True)], "need_id string, module_id string, name string, supported boolean")
    g = spark.createDataFrame([("n", "passed", 1)], "need_id string, status string, solutions int")
    nodes, edges = solutions.route(s, g)
    assert sorted(r.node_id for r in nodes.collect()) == ["R01", "R02", "R03"]
    assert {(r.source, r.target) for r in edges.collect()} == {("R01", "R02"), ("R02", "R03")}
    assert solutions.cyclic_nodes(nodes, edges).count() == 0
    more = edges.union(spark.createDataFrame([("n", "R03", "R02")], "need_id string, source string, target string"))
    assert sorted(r.node_id for r in solutions.cyclic_nodes(nodes, more).collect()) == ["R02", "R03"]
    with pytest.raises(ValueError):
        solutions.cyclic_nodes(nodes, edges.union(spark.createDataFrame([("n", "R03", "R99")], "need_id string, source string, target string")))


def test_files(spark, tmp_path):
    (tmp_path / "lib/Li").mkdir(parents=True)
    (tmp_path / "lib/.git").mkdir()
    for name, body in (("Li/a.PDF", b"%PDF-1"), ("Li/b.pdf", b"%PDF-1"), ("c.pdf", b"nope"), (".git/d.pdf", b"%PDF-2"), ("e.txt", b"%PDF-3")):
        (tmp_path / "lib" / name).write_bytes(body)
    root = str(tmp_path / "lib")
    found = files.pdf_files(spark, root, content=True)
    assert found.count() == 3
    owners = {r.path.rsplit("/", 1)[1]: r.o for r in found.select("path", files.owner_of(F.col("path"), root).alias("o")).collect()}
    assert owners == {"a.PDF": "Li", "b.pdf": "Li", "c.pdf": ""}
    known = spark.createDataFrame([], "paper_id string")
    assert {r.path.rsplit("/", 1)[1]: r.status for r in files.accept_uploads(found, known).collect()} == {"a.PDF": "accepted", "b.pdf": "duplicate", "c.pdf": "not_pdf"}
    listing = files.pdf_files(spark, root)
    assert catalog.new_files(listing, listing.where(F.col("path").endswith("c.pdf"))).count() == 2
    assert catalog.register(found).count() == 2
    (tmp_path / "q.jsonl").write_text('{"query_id": "1", "query": "a"}\n\n{"query_id": "2", "query": "b"}\n')
    assert files.queries(spark, str(tmp_path / "q.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"query_id": "1", "query": "a"}\n{oops\n')
    with pytest.raises(ValueError, match="'line': 2, 'text': '{oops'"):
        files.queries(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "dup.jsonl").write_text('{"query_id": "1", "query": "a"}\n{"query_id": "1", "query": "b"}\n')
    with pytest.raises(ValueError, match="twice"):
        files.queries(spark, str(tmp_path / "dup.jsonl"))


def test_versions(spark, tmp_path):
    empty = spark.createDataFrame([], files.VERSION)
    row = lambda v, parent, status, need="n": spark.createDataFrame([(v, need, parent, status, v, None, "{}")], files.VERSION)
    first = files.new_versions(empty, row("v1", None, "system_parsed"))
    second = first.union(files.new_versions(first, row("v2", "v1", "confirmed_by_user")))
    second.write.json(str(tmp_path / "v"))
    assert [r.version_id for r in files.versions(spark, str(tmp_path / "v")).collect()] == ["v2", "v1"]
    assert [tuple(r) for r in files.version_chain(second).collect()] == [("v2", "v1", 1)]
    for bad in (row("v3", "v9", "system_parsed"), row("v3", "v1", "system_parsed", "other"), row("v3", None, "confirmed_by_user")):
        with pytest.raises(ValueError):
            files.new_versions(second, bad)
    second.withColumn("profile", F.lit("{1}")).write.json(str(tmp_path / "w"))
    with pytest.raises(ValueError, match="changed"):
        files.versions(spark, str(tmp_path / "w"))


def test_streams(spark, tmp_path):
    def put(n, rows):
        spark.createDataFrame(rows, "id int, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put(1, [(1, "a"), (2, "b")])
    rows = lambda: ingest.once_per_content(ingest.new_rows(spark, str(tmp_path / "in"), "id int, t string", 1), ["t"])
    go = lambda: ingest.run_available(rows(), str(tmp_path / "out"), str(tmp_path / "cp"))
    go()
    put(2, [(3, "a"), (4, "c")])
    go()
    go()
    assert sorted(r.t for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    (tmp_path / "box").mkdir()
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / "box" / name).write_bytes(b"%PDF-x")
    seen = []
    ingest.run_batches(ingest.uploads(spark, str(tmp_path / "box")), lambda df, n: seen.extend(df.select("paper_id").collect()), str(tmp_path / "cp2"))
    assert len(seen) == 1


def test_dense_search_both_ways(spark, monkeypatch):
    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0]), (103, [1.0, None, 2.0])]
    c = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([("a", [1.0, 2.0, 0.5]), ("b", [0.0, 0.0, 0.0]), ("c", None), ("d", [2.0, 0.0, 1.0]), ("e", [3.0])], "query_id string, embedding array<double>")
    got = lambda: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in retrieval.dense_search(c, q, 7).collect())
    block = got()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 1)
    assert block == got() and {x[0] for x in block} == {"a", "d", "e"} and len(block) == 15
    assert retrieval.dense_search(c, q.limit(0), 3).count() == 0 and retrieval.dense_search(c.limit(0), q, 3).count() == 0


def test_grouped_search_against_loops(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(60, 4)), rng.normal(size=(5, 4))
    rows = [(i, "abc"[i % 3] if i % 10 else None, v[i].tolist()) for i in range(60)] + [(100, "a", v[0].tolist()), (101, "a", None)]
    c = spark.createDataFrame(rows, "chunk_id long, g string, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<double>")
    for least in (None, 0.3):
        got = {(r.query_id, r.g, r.rank): r.chunk_id for r in retrieval.grouped_search(c, asked, "g", 4, F.col("chunk_id"), least=least).collect()}
        want = {}
        for i, x in enumerate(q):
            score = lambda y: round(min(1, max(0, float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)))), 9)  # noqa: E731, B023
            for g in ("a", "b", "c", None):
                own = sorted((-score(np.array(e)), n) for n, h, e in rows if h == g and e is not None)
                for k, (s, n) in enumerate([o for o in own if least is None or -o[0] >= least][:4]):
                    want[i, g, k + 1] = n
        assert got == want


def test_broadcast_by_bytes(spark):
    from evigrain.operators.shared import small

    hinted = lambda df, **kw: "broadcast" in small(df, **kw)._jdf.queryExecution().logical().toString().lower()
    df = spark.createDataFrame([(i, "x" * 1000, [1.0] * 100) for i in range(50)], "i int, t string, v array<double>")
    assert hinted(df) and not hinted(df, rows=49) and not hinted(df, size=80_000) and hinted(df, size=100_000)


def test_version_chain_of_any_length(spark):
    rows = [(f"v{i}", f"v{i - 1}" if i else None) for i in range(151)]
    got = files.version_chain(spark.createDataFrame(rows, "version_id string, parent_version_id string")).collect()
    assert sorted((int(r.version_id[1:]), int(r.ancestor_id[1:]), r.distance) for r in got) == [(i, j, i - j) for i in range(151) for j in range(i)]
    with pytest.raises(ValueError, match="own ancestor"):
        files.version_chain(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "version_id string, parent_version_id string"))
