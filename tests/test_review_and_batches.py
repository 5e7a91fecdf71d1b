import json

import pytest
from pyspark.sql import functions as F

from evigrain.functions import vectors as vx
from evigrain.operators import catalog, evaluation, evidence, layout, metrics, retrieval, solutions, structured
from evigrain.plans import batches, experiment, workflow
from evigrain.sources import files
from evigrain.streaming import ingest, progress


def test_reviews(spark):
    rec = spark.createDataFrame([("n1", "Li"), ("n2", "Li"), ("n3", "Wu"), ("n4", "Li")], "need_id string, teacher string")
    shown = spark.createDataFrame([("n1", "Li", "Li"), ("n2", "Li", "Wu"), ("n2", "Li", "Li"), ("n4", "Li", "Li")], "need_id string, teacher string, evidence_teacher string")
    tech = spark.createDataFrame([("n1", "Li", "a"), ("n2", "Li", "b"), ("n4", "Li", "c")], "need_id string, teacher string, item string")
    told = spark.createDataFrame([("Li", "a", 2), ("Li", "b", 1), ("Li", "b", 0)], "teacher string, item string, sources int")
    rows = solutions.review(rec, shown, tech, told)
    got = {r.need_id: (r.status, r.paper_evidence_count, r.profile_evidence_checked, r.issues) for r in rows.collect()}
    assert got["n1"] == ("passed", 1, 1, []) and got["n3"] == ("needs_review", 0, 0, ["no evidence from papers"])
    assert got["n2"] == ("needs_review", 2, 1, ["evidence of another teacher", "a technology without a source"]) and got["n4"][3] == ["a technology without a source"]
    assert {r.need_id: r.overall_status for r in solutions.overall(rows).collect()}["n1"] == "passed"


def test_bundles_are_traced(spark):
    schema = "need_id string, original_request string, evidence_map array<struct<field:string,value:string,phrases:array<string>>>"
    p = spark.createDataFrame([("n", "We need Low cost and area", [("c", "cheap", ["low COST"]), ("c", "big", ["huge"]), ("c", "none", [])])], schema)
    sup = "need_id string, module_id string, name string, supported boolean, evidence array<struct<rank:int,chunk_id:string,similarity:double>>"
    e = [(1, "c", 0.5)]
    rows = [("n", "M01", "cheap", True, e), ("n", "M02", "big", True, e), ("n", "M03", "none", False, None), ("n", "M04", "cheap", True, []), ("n", "M05", "cheap", True, [(1, None, 0.5)]), ("n", "M06", "cheap", False, None), ("n", "M06", "cheap", False, None)]
    nodes = spark.createDataFrame([("n", "R01"), ("n", "R02")], "need_id string, node_id string")
    edges = spark.createDataFrame([("n", "R01", "R02"), ("n", "R02", "R01")], "need_id string, source string, target string")
    got = {(r.about, r.problem) for r in solutions.invalid_bundles(p, spark.createDataFrame(rows, sup), edges, nodes).collect()}
    assert got == {("M02", "a phrase that is not in the request"), ("M03", "a module without a phrase of the request"), ("M04", "a supported module without evidence"), ("M05", "evidence that lacks a field"), ("M06", "a module occurs twice"), ("R01", "a route with a cycle"), ("R02", "a route with a cycle")}
    w = spark.range(1).select(solutions.known_weight({"demand_fit": F.lit(1.0), "evidence_strength": F.lit(None), "engineering_maturity": F.lit(None), "landing_constraints": F.lit(0.0)}).alias("w"))
    assert w.first().w == 0.5


def test_sources_of_records(spark):
    src = lambda *s: [("research_direction", "x", list(s))]
    rows = [(("f1", "T", "A", "Li", 2020), "p", ["x"], [], [], [], src(("c1", 2, 3), ("c9", 1, 1))), (("f2", "T", "A", "Li", 2020), "p", ["x"], [], [], [], src(("c1", 2, 3), ("c2", 3, 9), ("c2", 4, 3)))]
    records = spark.createDataFrame(rows, files.CAPABILITY).withColumn("_source_file", F.col("paper.file_name"))
    chunks = spark.createDataFrame([("c1", "f1", 1, 3), ("c2", "f2", 3, 5)], "chunk_id string, file_name string, page_start int, page_end int")
    got = sorted(tuple(r) for r in evidence.source_problems(records, chunks).collect())
    assert got == [("f1", "c9", "unknown chunk"), ("f2", "c1", "chunk of another paper"), ("f2", "c2", "pages outside the chunk")]


def test_capability_evidence(spark):
    rows = [(f"c{i}", "f", "body " * 5 if i else "见 参考文献", i + 1, i + 1, [1.0, i / 10.0]) for i in range(6)] + [("g1", "g", "x", 1, 1, [0.0, 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_name string, text string, page_start int, page_end int, embedding array<double>")
    fields = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "query_id string, embedding array<double>")
    got = {(r.file_name, r.source_label): (r.chunk_id, r.matched_fields) for r in evidence.capability_evidence(chunks, fields, ["a", "b"], 2, 3).collect()}
    assert got == {("f", "S01"): ("c1", ["a"]), ("f", "S02"): ("c5", ["b"]), ("f", "S03"): ("c2", ["a"]), ("g", "S01"): ("g1", ["a", "b"])}


def test_rules_of_catalog_rows(spark):
    base = {"paper_id": "s", "sha256": "s", "file_name": "f", "file_path": "p", "title": "t", "ingestion_status": "parsed", "source_type": "local", "year": 2020, "page_count": 1, "file_size_bytes": 1}
    schema = "paper_id string, sha256 string, file_name string, file_path string, title string, ingestion_status string, source_type string, year int, page_count int, file_size_bytes long"
    bad = [{}, {"paper_id": ""}, {"sha256": "x"}, {"title": " "}, {"ingestion_status": "odd"}, {"source_type": None}, {"year": 1700}, {"year": None}, {"page_count": -1}]
    rows = [tuple((base | b).values()) for b in bad]
    got = [r.rule for r in catalog.invalid_papers(spark.createDataFrame(rows, schema)).collect()]
    assert got == ["an id is missing", "the id is not the digest", "a name is missing", "unknown status", "unknown source", "year out of range", "a negative size"]
    tags = spark.createDataFrame([("p", "device", "v", "user", 0.5, "suggested"), ("p", "odd", "v", "user", 0.5, "suggested"), ("p", "device", "v", "user", 1.5, "suggested")], "paper_id string, category string, value string, source string, confidence double, review_status string")
    assert [r.rule for r in catalog.invalid_tags(tags).collect()] == ["unknown category", "confidence out of range"]
    papers = spark.createDataFrame([("Alpha", "a.pdf", ["Li Wei"]), ("Beta", "b.pdf", [])], "title string, file_name string, authors array<string>")
    assert catalog.choose_papers(papers, "wEI").count() == 1 and catalog.choose_papers(papers, "B.PDF").count() == 1 and catalog.choose_papers(papers).count() == 2
    with pytest.raises(ValueError, match="no paper"):
        catalog.choose_papers(papers, "zzz")


def test_seeds_and_metadata(spark, tmp_path):
    path = tmp_path / "seed.json"
    path.write_text(json.dumps({"papers": [{"file_name": "a.pdf", "title": "A title", "authors": [" Li ", ""], "teacher": "T", "year": 2020}]}))
    seed = files.metadata_seed(spark, str(path))
    parsed = spark.createDataFrame([("a.pdf", 3, None), ("b.x.pdf", 0, "v1")], "file_name string, total_pages int, parser_version string")
    paths = spark.createDataFrame([("a.pdf", "d1", "/a.pdf"), ("b.x.pdf", "d2", "/b.x.pdf")], "file_name string, paper_id string, file_path string")
    got = {r.file_name: r for r in catalog.parsed_as_papers(parsed, seed, paths, F.lit("now")).collect()}
    assert (got["a.pdf"].title, got["a.pdf"].authors, got["a.pdf"].teacher, got["a.pdf"].direction, got["a.pdf"].parser_version) == ("A title", ["Li"], "T", "unclassified", "legacy")
    assert (got["b.x.pdf"].title, got["b.x.pdf"].page_count, got["b.x.pdf"].authors) == ("b.x", None, [])
    with pytest.raises(ValueError, match="file is unknown"):
        catalog.parsed_as_papers(parsed, seed, paths.limit(1), F.lit("now"))
    assert files.metadata_seed(spark, str(tmp_path / "none.json")).count() == 0
    for wrong in ([{"file_name": "a.pdf"}, {"file_name": "a.pdf "}], [{"file_name": "d/a.pdf"}], [{"file_name": ""}]):
        path.write_text(json.dumps({"papers": wrong}))
        with pytest.raises(ValueError):
            files.metadata_seed(spark, str(path))
    chunks = spark.createDataFrame([("c", "a.pdf"), ("d", "zz")], "chunk_id string, file_name string")
    papers = spark.createDataFrame([("p", "a.pdf", "T", 2020)], "paper_id string, file_name string, teacher string, year int")
    assert {r.chunk_id: r.teacher for r in catalog.with_metadata(chunks, papers).collect()} == {"c": "T", "d": None}


def test_vectors_are_replaced_whole(spark):
    v = lambda *r: spark.createDataFrame(list(r), "chunk_id string, embedding array<double>")
    got = catalog.upsert_vectors(v(("a", [1.0, 0.0]), ("b", [0.0, 1.0])), v(("b", [0.5, 0.5]), ("c", [1.0, 1.0]))).collect()
    assert {r.chunk_id: r.embedding for r in got} == {"a": [1.0, 0.0], "b": [0.5, 0.5], "c": [1.0, 1.0]}
    for bad in (v(("d", [1.0])), v(("d", None)), v(("d", []))):
        with pytest.raises(ValueError):
            catalog.upsert_vectors(v(("a", [1.0, 0.0])), bad)
    with pytest.raises(Exception, match="one length"):
        spark.range(1).select(vx.strict_cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).collect()
    rows = spark.createDataFrame([("ok",), (None,)], "t string")
    got = workflow.checked(workflow.hashed_vectors, 5, workflow.QUERY_INSTRUCTION)(rows, "t", "v").collect()
    assert len(got[0].v) == workflow.DIMENSIONS and got[1].v is None
    for bad, match in ((" ", "empty"), ("a b c d e f", "more than 5")):
        with pytest.raises(Exception, match=match):
            workflow.checked(workflow.hashed_vectors, 5)(spark.createDataFrame([(bad,)], "t string"), "t", "v").collect()


def test_batches_never_abort(spark):
    rows = [(f"p{i}", f"t{i}", "T", "metadata_pending" if i < 4 else "failed", "", "1", "1") for i in range(6)]
    papers = spark.createDataFrame(rows, "paper_id string, title string, teacher string, ingestion_status string, error_message string, created_at string, updated_at string")

    def work(record):
        if record["paper_id"] == "p1":
            raise ValueError("broken " + "x" * 2000)
        return record["title"].upper()

    saved = []
    b = batches.run_batch(papers, lambda df: batches.attempt(df, work, "string"), batches.PARSING, F.lit("2"), lambda df: saved.append({r.paper_id: r.ingestion_status for r in df.collect()}), limit=5, retry_failed=True)
    assert (b.requested, b.completed, b.failed, b.paper_ids) == (5, 4, 1, ["p0", "p2", "p3", "p4"]) and b.errors[0].startswith("t1: broken")
    assert saved[0]["p0"] == "parsing" and saved[0]["p5"] == "failed"
    after = {r.paper_id: (r.ingestion_status, len(r.error_message)) for r in b.papers.collect()}
    assert after["p0"] == ("parsed", 0) and after["p1"] == ("failed", 1000) and after["p5"] == ("failed", 0)
    assert {r.result for r in b.results.collect()} == {"T0", "T2", "T3", "T4"}
    again = batches.run_batch(b.papers, lambda df: batches.attempt(df, lambda r: "v", "string"), batches.INDEXING, F.lit("3"))
    assert again.completed == 4 and {r.ingestion_status for r in again.papers.where("paper_id = 'p0'").collect()} == {"indexed"}
    with pytest.raises(ValueError):
        batches.run_batch(papers, lambda df: df, batches.PARSING, F.lit("2"), limit=101)


def test_experiments(spark, tmp_path):
    c = spark.createDataFrame([("a", "red fox", [1.0, 0.0]), ("b", "red red", [0.0, 1.0])], "chunk_id string, text string, embedding array<double>")
    q = spark.createDataFrame([("q1", "fox", [1.0, 0.1]), ("q2", "nothing", None)], "query_id string, query string, embedding array<double>")
    judged = spark.createDataFrame([("q1", "a", 1), ("q2", "b", 1)], files.QREL)
    m = experiment.run_experiment(c, q, ["bm25", "dense", "bm25"], str(tmp_path / "x"), 2, qrels=judged)
    assert list(m["methods"]) == ["bm25", "dense"] and m["methods"]["bm25"]["metrics"]["5"] == {"recall": 0.5, "mrr": 0.5, "ndcg": 0.5}
    run = {r.query_id: r.chunk_ids for r in spark.read.json(str(tmp_path / "x/dense")).collect()}
    assert run == {"q1": ["a", "b"], "q2": []}
    assert json.loads(spark.read.text(str(tmp_path / "x/manifest")).first().value)["queries_sha256"] == m["queries_sha256"] == experiment.digest(q.orderBy(F.desc("query_id")))
    assert experiment.run_experiment(c, q, ["bm25"], str(tmp_path / "y"), 2)["quality_evaluation"]["status"] == "not_run"
    for kw in ({"methods": ["no"]}, {"methods": ["rerank"]}, {"methods": ["rrf"], "rrf_k": 0}):
        with pytest.raises(ValueError):
            experiment.run_experiment(c, q, folder=str(tmp_path / "z"), **kw)


def reading(**more):
    base = {
        "executive_summary": {"text": " a  b ", "source_labels": ["E01"]},
        "innovations": [{"claim": "x", "source_labels": ["E01", "E01"]}, {"claim": " ", "source_labels": []}],
        "method_steps": [{"name": "cut", "description": "it", "source_labels": ["E02"]}],
        "figure_interpretations": [{"asset_id": "F1", "observation": "o", "meaning": "m", "source_labels": ["F1"]}],
        "uncertainties": ["u ", ""],
    }
    return json.dumps(base | more)


def test_deep_readings(spark):
    cases = [
        (reading(), None),
        ("x", "no JSON object"),
        (reading(key_findings=[{"claim": "c", "source_labels": ["E99"]}]), "an unknown label"),
        (reading(key_findings=[{"claim": "c", "source_labels": []}]), "a claim without labels"),
        (reading(figure_interpretations=[{"asset_id": "F9", "observation": "o", "source_labels": ["F1"]}]), "an unknown figure"),
        (reading(figure_interpretations=[{"asset_id": "F1", "observation": "o", "source_labels": ["E01"]}]), "a reading that doesn't cite its object"),
        (reading(key_findings=[{"claim": f"c{i}", "source_labels": ["E01"]} for i in range(9)]), None),
    ]
    rows = [(i, "T", a, ["E01", "E02"], ["F1"], ["Q1"]) for i, (a, _) in enumerate(cases)]
    got = structured.parse_readings(spark.createDataFrame(rows, "paper_id int, title string, answer string, evidence_labels array<string>, figure_labels array<string>, formula_labels array<string>")).persist()
    by = {r.paper_id: r for r in got.collect()}
    assert [by[i].problem for i in range(len(cases))] == [p for _, p in cases]
    one = by[0].reading
    assert one.executive_summary.text == "a b" and [(c.claim, c.source_labels) for c in one.innovations] == [("x", ["E01"])] and one.uncertainties == ["u"] and len(by[6].reading.key_findings) == 8
    report = {r.paper_id: r.report for r in structured.deep_reports(got).collect()}
    assert sorted(report) == [0, 6] and "- cut: it [E02]" in report[0] and "- F1 o m [F1]" in report[0] and "## limitations\n\n待核对" in report[0]
    route = [(r.node_id, r.kind, r.label) for r in structured.reading_route(got).where("paper_id = 6").orderBy("place").collect()]
    assert route == [("P01", "goal", ""), ("M01", "method", "cut：it"), ("R01", "finding", "c0"), ("R02", "finding", "c1"), ("R03", "finding", "c2")]
    assert solutions.diagram("p", [(a, c) for a, _, c in route], [("P01", "M01")]).count("mxCell") > 5


def test_installs_and_progress(spark, tmp_path):
    df = spark.range(3)
    files.install({str(tmp_path / "a"): df, str(tmp_path / "b"): df})
    with pytest.raises(ValueError):
        files.install({str(tmp_path / "c"): df, str(tmp_path / "b"): df})
    assert not (tmp_path / "c").exists() and files.metric_records(spark, str(tmp_path / "none/*.json"), "metric_id string").count() == 0
    seen = []
    stop = progress.watch(spark, seen.append)
    ingest.run_available(ingest.new_rows(spark, str(tmp_path / "a"), "id long"), str(tmp_path / "out"), str(tmp_path / "cp"))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stop()
    assert any(e.get("rows") == 3 for e in seen) and retrieval is not None


@pytest.mark.parametrize("gathered", [0, 50, 10**6])
def test_quantiles_of_groups_of_any_size(spark, gathered):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"one": [4.5], "two": [1.0, 2.0], "same": [7.0] * 90, "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, 1.0], "skew": [*rng.lognormal(0, 9, 400).tolist(), *[3.25] * 100], "many": rng.normal(size=2000).round(2).tolist(), "near": [1.0 + k * 2**-52 for k in range(300)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("many", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in evaluation.latency(df, "v", ["g"], gathered).collect()}
    for g, vs in groups.items():
        vs = sorted(vs)
        n = len(vs)
        assert (got[g].n, got[g].p95, got[g].max) == (n, vs[-(-95 * n // 100) - 1], vs[-1])
        assert got[g].p50 == pytest.approx(vs[(n - 1) // 2] / 2 + vs[n // 2] / 2)
    whole = evaluation.latency(df.where("g in ('many', 'skew')"), "v", [], gathered).first()
    both = sorted(groups["many"] + groups["skew"])
    assert (whole.n, whole.p95) == (2500, both[-(-95 * 2500 // 100) - 1]) and whole.p50 == pytest.approx((both[1249] + both[1250]) / 2)


def test_comparable_groups(spark):
    rows = [("a", "m", "u", "c"), ("b", "m", "u", "c"), ("c", "m", "u", "d"), ("d", "m", "u", ""), ("e", "m", "u", ""), ("f", "m", "v", "c"), ("0", "m", "u", "c")]
    df = spark.createDataFrame(rows, "metric_id string, definition_id string, canonical_unit string, test_condition string")
    got = sorted((r.group_id, r.members, r.metric_id) for r in metrics.comparable(df).collect())
    assert got == [("0", 3, "0"), ("0", 3, "a"), ("0", 3, "b")]


def test_chunk_samples_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(f"c{k}", "f" if k % 2 else "g", "x" * k) for k in range(30)], "chunk_id string, file_name string, text string")
    a, b = (sorted(map(tuple, layout.chunk_summary(d, ["file_name"], 3, 1).collect())) for d in (df, df.orderBy("text").repartition(7)))
    assert a == b and all(len(r[-1]) == 3 for r in a)
    assert a != sorted(map(tuple, layout.chunk_summary(df, ["file_name"], 3, 2).collect()))
    assert len(layout.chunk_summary(df, [], 40).first().samples) == 30


def test_stored_digests_take_the_place_of_state(spark):
    from evigrain.operators.shared import shared_path
    from evigrain.sources import buckets
    from evigrain.streaming import ingest

    at = shared_path(spark, "stored")
    known = buckets.catalog(spark, f"{at}/known", "content_id string", "content_id", 4)
    run = lambda: ingest.once_per_content_stored(spark.readStream.schema("id long, t string").option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*"), F.sha2("t", 256), known, f"{at}/out", f"{at}/progress")
    put = lambda name, *rows: spark.createDataFrame(list(rows), "id long, t string").coalesce(1).write.parquet(f"{at}/in/{name}")
    kept = lambda: sorted((r.id, r.t) for r in spark.read.schema("id long, t string, content_id string").parquet(f"{at}/out").collect())
    put("a", (1, "x"), (2, "y"))
    run()
    put("b", (3, "x"), (4, "z"))
    run()
    run()
    assert kept() == [(1, "x"), (2, "y"), (4, "z")] and known.rows().count() == 3
    # the second batch again, as after a failure between its two writes
    batch = spark.createDataFrame([(3, "x"), (4, "z")], "id long, t string").withColumn("content_id", F.sha2("t", 256))
    assert [r.id for r in known.fresh(batch, 1).collect()] == [4]


def test_cycles_of_random_graphs_and_long_chains(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    graphs = {}
    for g in range(40):
        n = int(rng.integers(1, 12))
        graphs[f"g{g}"] = n, {(int(a), int(b)) for a, b in rng.integers(0, n, (int(rng.integers(0, n + 4)), 2)) if g % 3 or a < b}
    graphs["chain"] = 700, {(k, k + 1) for k in range(699)}
    graphs["ring"] = 300, {(k, (k + 1) % 200) for k in range(200)} | {(k, k + 1) for k in range(199, 299)}
    graphs["joined"] = 9, {(0, 1), (1, 2), (2, 1), (2, 3), (4, 3), (3, 5), (6, 7), (4, 7), (7, 8)}
    want = set()
    for g, (n, edges) in graphs.items():
        left = set(range(n))
        while gone := {x for x in left if not any(b == x and a in left for a, b in edges)}:
            left -= gone
        want |= {(g, x) for x in left}
    nodes = spark.createDataFrame([(g, x) for g, (n, _) in graphs.items() for x in range(n)], "need_id string, node_id long")
    edges = spark.createDataFrame([(g, a, b) for g, (_, es) in graphs.items() for a, b in es], "need_id string, source long, target long")
    got = [(r.need_id, r.node_id) for r in solutions.cyclic_nodes(nodes, edges).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("ring", 250) in want and ("joined", 5) in want


def test_every_record_has_its_number_of_comparable_ones(spark):
    rows = [("a", "m", "u", "c"), ("b", "m", "u", "c"), ("c", "m", "u", "d"), ("d", "m", "u", ""), ("e", "m", "u", ""), ("f", "m", "v", "c"), ("0", "m", "u", "c"), ("n", "m", "u", None)]
    df = spark.createDataFrame(rows, "metric_id string, definition_id string, canonical_unit string, test_condition string")
    got = {r.metric_id: (r.group_id, r.members, r.n_links) for r in metrics.comparable_links(df).collect()}
    assert got == {k: ("0", 3, 2) for k in "0ab"} | {k: (k, 1, 0) for k in "cdefn"}
    assert sum(n for _, _, n in got.values()) == 2 * sum(n * (n - 1) // 2 for n in (3,))


def test_answers_of_a_small_table_are_parsed_by_all_cores(spark):
    rows = spark.range(20).coalesce(1).select(F.col("id").alias("paper_id"), F.lit("{}").alias("answer"), F.array(F.lit("S01")).alias("labels"))
    got = structured.parse_extractions(rows)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and got.count() == 20
