"""From confirmed needs to a gated solution: questions, modules, gate, route graph, transfer evaluation, plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import TRANSFER_WEIGHTS, band, known_mean, to_step
from .matching import ordered_distinct
from .needs import UNKNOWN
from .shared import checkpoint_dir, require_none, top_k

# Hints that tie capabilities to problems and to metrics.
PROBLEM_HINTS = {
    "高灵敏度": ("灵敏度", "探测能力"),
    "低成本": ("成本",),
    "大面积": ("大面积", "面积"),
    "高分辨率": ("分辨率", "图像模糊"),
    "高稳定性": ("稳定性", "衰减", "基线漂移", "寿命"),
    "快速响应": ("响应", "实时", "高速"),
    "低电压": ("电压", "偏压"),
}
METRIC_HINTS = {
    "X射线能量": ("X射线", "探测", "成像"),
    "检测精度": ("同心度", "测量", "检测"),
    "检测频率": ("在线", "快速", "检测"),
    "检测可靠性": ("稳定", "冗余", "检测"),
    "缺陷识别精度": ("缺陷", "智能检测"),
    "最小可检测缺陷尺寸": ("缺陷", "智能检测"),
    "检测速度": ("在线", "快速", "智能检测"),
    "灵敏度": ("灵敏度", "探测"),
    "检测限": ("检测限", "探测"),
    "分辨率": ("分辨率", "成像"),
    "成本": ("成本",),
    "面积": ("面积", "尺寸", "规模"),
    "尺寸": ("面积", "尺寸", "规模"),
    "电压": ("电压", "偏压", "自驱动"),
    "响应时间": ("响应", "实时", "高速"),
    "稳定性": ("稳定", "寿命"),
    "寿命": ("稳定", "寿命"),
}
EVIDENCE_PER_MODULE = 3


def _has(c: Column, words) -> Column:
    return F.greatest(F.lit(False), F.lit(False), *[F.contains(c, F.lit(w)) for w in words])


def clarification(profiles: DataFrame) -> DataFrame:
    """(need_id, place, field, severity, about): what must be asked; blocking questions stop acceptance."""
    q = lambda ok, field, severity, about=None: F.when(ok, F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), (F.lit("") if about is None else about).alias("about")))
    none = lambda c: F.size(c) == 0
    kind = "array<struct<field:string,severity:string,about:string>>"
    conditions = F.transform(
        F.filter("target_metrics", lambda m: F.coalesce(m["test_condition"], F.lit("")) == ""),
        lambda m: F.struct(F.concat(F.lit("target_metrics."), m["metric_id"], F.lit(".test_condition")).alias("field"), F.lit("blocking").alias("severity"), m["raw_text"].alias("about")),
    )
    head = F.array(
        q(F.col("industry") == UNKNOWN, "industry", "blocking"),
        q(F.col("product") == UNKNOWN, "product", "blocking"),
        q(none("technical_problems"), "technical_problems", "important"),
        q(none("required_capabilities"), "required_capabilities", "blocking"),
        q(none("target_metrics"), "target_metrics", "blocking"),
    )
    tail = F.array(
        q(none("constraints"), "constraints", "important"), q(none("existing_foundations"), "existing_foundations", "important"), q(none("excluded_approaches"), "excluded_approaches", "informational")
    )
    rest = F.transform("unparsed_fragments", lambda c: F.struct(F.lit("unparsed_fragments").alias("field"), F.lit("important").alias("severity"), c.alias("about")))
    every = F.concat(F.array_compact(head).cast(kind), conditions.cast(kind), F.array_compact(tail).cast(kind), rest.cast(kind))
    return profiles.select("need_id", F.posexplode(every).alias("at", "q")).select("need_id", (F.col("at") + 1).alias("place"), "q.*")


def modules(profiles: DataFrame) -> DataFrame:
    """One row a module: its capability (or problem, without capabilities), the related problem and its metrics."""
    caps, problems = ordered_distinct(F.col("required_capabilities")), ordered_distinct(F.col("technical_problems"))
    rows = profiles.select("need_id", "product", "target_metrics", problems.alias("_p"), (F.size(caps) > 0).alias("is_capability"), F.posexplode(F.when(F.size(caps) > 0, caps).otherwise(problems)).alias("at", "name"))
    first = lambda ws: F.get(F.filter("_p", lambda p: _has(p, ws)), F.lit(0))
    related = F.coalesce(*[F.when(F.contains("name", F.lit(h)), first(ws)) for h, ws in PROBLEM_HINTS.items()])
    fits = lambda m: F.coalesce(*[F.when(m["name"] == n, _has(F.col("name"), ws)) for n, ws in METRIC_HINTS.items()], F.lit(False))
    return rows.select(
        "need_id", F.format_string("M%02d", F.col("at") + 1).alias("module_id"), "name", "is_capability", "product", F.when(F.col("is_capability"), related).otherwise(F.col("name")).alias("problem"), F.filter("target_metrics", fits).alias("metrics")
    )


def support(modules_: DataFrame, evidence: DataFrame, chosen: DataFrame) -> DataFrame:
    """modules with teacher, up to three evidence rows of the chosen teacher, best similarity and whether supported.

    evidence: need_id, module_id, teacher, chunk_id, similarity; chosen: need_id, teacher.
    """
    own = top_k(evidence.join(chosen, ["need_id", "teacher"]), ["need_id", "module_id"], [F.desc("similarity"), F.col("chunk_id")], EVIDENCE_PER_MODULE)
    own = own.groupBy("need_id", "module_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "similarity"))).alias("evidence"), F.max("similarity").alias("best"))
    rows = modules_.join(chosen, "need_id", "left").join(own, ["need_id", "module_id"], "left")
    return rows.withColumn("supported", F.col("evidence").isNotNull())


def gate(profiles: DataFrame, supported: DataFrame) -> DataFrame:
    """(need_id, status, solutions): blocked, provisional or passed; there is one solution at most."""
    per = supported.groupBy("need_id").agg(F.count("*").alias("modules"), F.count_if("supported").alias("ok"), F.count_if(F.col("teacher").isNotNull()).alias("matched"))
    rows = profiles.select("need_id", "confirmed", "target_metrics").join(per, "need_id", "left").fillna(0, ["modules", "ok", "matched"])
    blocked = ~F.col("confirmed") | (F.col("matched") == 0) | (F.col("ok") == 0)
    passed = (F.size("target_metrics") > 0) & (F.col("ok") == F.col("modules"))
    return rows.select("need_id", F.when(blocked, "blocked").when(passed, "passed").otherwise("provisional").alias("status"), F.when(blocked, 0).otherwise(1).alias("solutions"))


def route(supported: DataFrame, gates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (need_id, node_id, stage, name, status) and edges (need_id, source, target) of needs that aren't blocked.

    First the requirements are frozen, then each module is verified, then all are integrated if they are several, last
    comes the site.
    """
    open_ = supported.join(gates.where("solutions > 0").select("need_id"), "need_id", "left_semi")
    per = open_.groupBy("need_id").agg(F.array_sort(F.collect_list(F.struct("module_id", "name", "supported"))).alias("ms"))
    name = lambda n: F.format_string("R%02d", n)
    node = lambda i, stage, label, status: F.struct(name(i).alias("node_id"), F.lit(stage).alias("stage"), label.alias("name"), status.alias("status"))
    planned, n = F.lit("planned"), F.size("ms")
    checks = F.transform("ms", lambda m, i: node(i + 2, "module", m["name"], F.when(m["supported"], "planned").otherwise("blocked")))
    joint = F.when(n > 1, F.array(node(n + 2, "integration", F.lit("integration"), planned))).otherwise(F.array_except(F.array(node(n + 2, "integration", F.lit("integration"), planned)), F.array(node(n + 2, "integration", F.lit("integration"), planned))))
    last = F.when(n > 1, n + 3).otherwise(n + 2)
    nodes = F.concat(F.array(node(F.lit(1), "requirements", F.lit("requirements"), planned)), checks, joint, F.array(node(last, "site", F.lit("site"), planned)))
    edge = lambda a, b: F.struct(a.alias("source"), b.alias("target"))
    ids = F.transform("ms", lambda m, i: name(i + 2))
    edges = F.concat(F.transform(ids, lambda x: edge(name(F.lit(1)), x)), F.transform(ids, lambda x: edge(x, F.when(n > 1, name(n + 2)).otherwise(name(last)))), F.filter(F.array(F.when(n > 1, edge(name(n + 2), name(last)))), lambda e: e.isNotNull()))
    return per.select("need_id", F.explode(nodes).alias("x")).select("need_id", "x.*"), per.select("need_id", F.explode(edges).alias("x")).select("need_id", "x.*")


def cyclic_nodes(nodes: DataFrame, edges: DataFrame, graph: str = "need_id") -> DataFrame:
    """Nodes that can't be taken off a graph from its sources, that is on or behind a cycle. Edges to unknown nodes are an error.

    A node with one edge into it goes when the node before it goes, so it stands with the last one before it that has none
    or several: chains are skipped by jumps of doubled length. Of the nodes with several edges, those that can go are taken
    off level by level. All steps are written to the checkpoint folder, so that lineage stays short.
    """
    for end in ("source", "target"):
        require_none(edges.select(graph, F.col(end).alias("node_id")).join(nodes.select(graph, "node_id"), [graph, "node_id"], "left_anti"), "an edge has an unknown end")
    checkpoint_dir(nodes.sparkSession)
    live = edges.select(graph, "source", "target").distinct().checkpoint()
    into = live.groupBy(graph, F.col("target").alias("node_id")).agg(F.count("*").alias("n"), F.min("source").alias("at"))
    known = nodes.select(graph, "node_id").distinct().join(into, [graph, "node_id"], "left").select(graph, "node_id", F.coalesce("n", F.lit(0)).alias("n"), "at").checkpoint()
    single = known.where("n = 1").select(graph, "node_id", "at")
    for _ in range(single.count().bit_length()):
        further = single.select(graph, F.col("node_id").alias("at"), F.col("at").alias("_at"))
        single = single.join(further, [graph, "at"], "left").select(graph, "node_id", F.coalesce("_at", "at").alias("at")).checkpoint()
    # where all chains have been skipped, what still stands with a node of one edge is on or behind a cycle of such nodes
    ends = single.join(known.select(graph, F.col("node_id").alias("at"), F.col("n").alias("of")), [graph, "at"])
    round_ = ends.where("of = 1").select(graph, "node_id")
    stands = ends.where("of > 1").select(graph, "node_id", "at").unionByName(known.where("n > 1").select(graph, "node_id", F.col("node_id").alias("at"))).checkpoint()
    joints = live.join(known.where("n > 1").select(graph, F.col("node_id").alias("target")), [graph, "target"], "left_semi")
    stuck = joints.join(round_.withColumnRenamed("node_id", "source"), [graph, "source"], "left_semi").select(graph, F.col("target").alias("node_id")).distinct().checkpoint()
    live = joints.join(stands.withColumnRenamed("node_id", "source"), [graph, "source"]).select(graph, F.col("at").alias("source"), "target").distinct().checkpoint()
    left = known.where("n > 1").select(graph, "node_id")
    before, now = None, left.count()
    while now and now != before:
        held = live.select(graph, F.col("target").alias("node_id")).unionByName(stuck)
        left = left.join(held, [graph, "node_id"], "left_semi").checkpoint()
        live = live.join(left.select(graph, F.col("node_id").alias("source")), [graph, "source"], "left_semi").select(graph, "source", "target").checkpoint()
        before, now = now, left.count()
    behind = stands.join(left.withColumnRenamed("node_id", "at"), [graph, "at"], "left_semi").select(graph, "node_id")
    return round_.unionByName(behind)


def transfer(profiles: DataFrame, supported: DataFrame, questions: DataFrame) -> DataFrame:
    """Per need: known score in steps of five, its band, evidence completeness, and the decision."""
    per = supported.groupBy("need_id").agg(F.count("*").alias("modules"), F.count_if("supported").alias("ok"), F.avg("best").alias("strength"), F.count_if(F.col("teacher").isNotNull()).alias("matched"))
    asked = questions.groupBy("need_id").agg(F.count_if(F.col("severity") == "blocking").alias("blocking"))
    rows = profiles.select("need_id", "confirmed", "target_metrics").join(per, "need_id", "left").join(asked, "need_id", "left").fillna(0, ["modules", "ok", "matched", "blocking"])
    conditioned = F.size(F.filter("target_metrics", lambda m: F.coalesce(m["test_condition"], F.lit("")) != ""))
    metrics = F.size("target_metrics")
    complete = (metrics > 0) & (conditioned == metrics)
    fit = F.when(F.col("modules") > 0, F.bround(F.col("ok") / F.col("modules") * 100, 0))
    known = known_mean({"demand_fit": fit, "evidence_strength": F.bround(F.col("strength") * 100, 0), "engineering_maturity": F.lit(None).cast("double"), "landing_constraints": F.lit(None).cast("double")}, TRANSFER_WEIGHTS)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    every = (F.col("modules") > 0) & (F.col("ok") == F.col("modules"))
    return rows.select(
        "need_id",
        to_step(known).cast("int").alias("known_score"),
        band(to_step(known)).alias("known_band"),
        F.bround(100 * (share(F.col("ok"), F.col("modules")) * 0.6 + share(conditioned, metrics) * 0.4), 0).cast("int").alias("evidence_completeness"),
        F.when(~F.col("confirmed"), "pause_for_confirmation").when(~every | (F.col("matched") == 0), "pause_for_evidence").when(~complete | (F.col("blocking") > 0), "proceed_to_clarification").otherwise("proceed_to_feasibility").alias("decision"),
    )


def review(recommended: DataFrame, evidence: DataFrame, technologies: DataFrame, sources: DataFrame) -> DataFrame:
    """(need_id, teacher, status, paper_evidence_count, profile_evidence_checked, issues) of each recommendation.

    evidence: need_id, teacher, evidence_teacher; technologies: need_id, teacher, item; sources: (teacher, item, sources),
    a row for each paper that says an item, with the number of its places. A technology is traceable when some paper
    says it and every such paper names a place.
    """
    key = ["need_id", "teacher"]
    shown = evidence.groupBy(*key).agg(F.count("*").alias("shown"), F.count_if(~F.col("evidence_teacher").eqNullSafe(F.col("teacher"))).alias("foreign"))
    told = sources.groupBy("teacher", "item").agg(F.count_if(F.coalesce("sources", F.lit(0)) < 1).alias("blank"))
    traced = technologies.join(told, ["teacher", "item"], "left").groupBy(*key).agg(F.count("*").alias("checked"), F.count_if(F.coalesce("blank", F.lit(1)) > 0).alias("untraced"))
    rows = recommended.select(*key).join(shown, key, "left").join(traced, key, "left").fillna(0, ["shown", "foreign", "checked", "untraced"])
    found = {"no evidence from papers": F.col("shown") == 0, "evidence of another teacher": F.col("foreign") > 0, "a technology without a source": F.col("untraced") > 0}
    issues = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in found.items()]))
    return rows.select(*key, F.when(F.size(issues) == 0, "passed").otherwise("needs_review").alias("status"), F.col("shown").alias("paper_evidence_count"), F.col("checked").alias("profile_evidence_checked"), issues.alias("issues"))


def overall(reviews: DataFrame) -> DataFrame:
    """(need_id, overall_status, checked): passed where all of a need's recommendations pass."""
    return reviews.groupBy("need_id").agg(F.when(F.every(F.col("status") == "passed"), "passed").otherwise("needs_review").alias("overall_status"), F.count("*").alias("checked"))


def known_weight(scores: dict[str, Column]) -> Column:
    """What the known parts of a transfer weigh together, to two places."""
    return F.round(sum((F.when(scores[n].isNotNull(), w).otherwise(0.0) for n, w in TRANSFER_WEIGHTS.items()), F.lit(0.0)), 2)


#: What a module's evidence must say of itself.
EVIDENCE_FIELDS = ("chunk_id", "similarity")


def invalid_bundles(profiles: DataFrame, supported: DataFrame, edges: DataFrame, nodes: DataFrame, fields=EVIDENCE_FIELDS) -> DataFrame:
    """(need_id, problem, about) of solutions that can't be traced: what a bundle is checked for before it is handed out.

    profiles: need_id, original_request, evidence_map; supported: need_id, module_id, name, supported, evidence; edges and
    nodes: a route's. A module's name must be a value of the need with phrases that stand in the request.
    """
    twice = supported.groupBy("need_id", "module_id").count().where("count > 1").select("need_id", F.lit("a module occurs twice").alias("problem"), F.col("module_id").alias("about"))
    rows = supported.select("need_id", "module_id", "name", "supported", "evidence").join(profiles.select("need_id", "original_request", "evidence_map"), "need_id", "left")
    said = F.flatten(F.transform(F.filter("evidence_map", lambda e: e["value"] == F.col("name")), lambda e: e["phrases"]))
    lost = F.exists(said, lambda p: ~F.contains(F.lower("original_request"), F.lower(p)))
    gaps = F.exists(F.coalesce("evidence", F.expr("filter(evidence, x -> false)")), lambda e: F.greatest(*[e[f].isNull() for f in fields]))
    problem = (
        F.when(F.coalesce(F.size(said), F.lit(0)) < 1, "a module without a phrase of the request")
        .when(lost, "a phrase that is not in the request")
        .when(F.col("supported") & (F.coalesce(F.size("evidence"), F.lit(0)) < 1), "a supported module without evidence")
        .when(F.coalesce(gaps, F.lit(False)), "evidence that lacks a field")
    )
    traced = rows.select("need_id", problem.alias("problem"), F.col("module_id").alias("about")).where("problem is not null")
    loops = cyclic_nodes(nodes, edges).select("need_id", F.lit("a route with a cycle").alias("problem"), F.col("node_id").alias("about"))
    return twice.unionByName(traced).unionByName(loops)


def landing_plan(nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """(need_id, milestone_id, node_id, name, blocked_by): a milestone a node; the first names a decision that isn't to proceed."""
    number = F.substring("node_id", 2, 9).cast("int")
    rows = nodes.join(decisions.select("need_id", "decision"), "need_id")
    stop = F.when((number == 1) & (F.col("decision") != "proceed_to_feasibility"), F.col("decision"))
    return rows.select("need_id", F.format_string("L%02d", number).alias("milestone_id"), "node_id", "name", stop.alias("blocked_by"))


def diagram(name: str, nodes: list[tuple[str, str]], edges: list[tuple[str, str]], columns: int = 4) -> str:
    """Diagram XML of (id, label) nodes in rows of `columns`, and (source, target) edges."""
    from xml.sax.saxutils import quoteattr

    cells = [f'<mxCell id={quoteattr(n)} value={quoteattr(label)} vertex="1" parent="1"><mxGeometry x="{40 + 220 * (i % columns)}" y="{40 + 120 * (i // columns)}" width="180" height="70" as="geometry"/></mxCell>' for i, (n, label) in enumerate(nodes)]
    cells += [f'<mxCell id="E{i}" edge="1" parent="1" source={quoteattr(a)} target={quoteattr(b)}><mxGeometry relative="1" as="geometry"/></mxCell>' for i, (a, b) in enumerate(edges)]
    return f'<mxfile><diagram name={quoteattr(name)}><mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/>{"".join(cells)}</root></mxGraphModel></diagram></mxfile>'


def drawio(nodes: DataFrame, edges: DataFrame, need: str) -> str:
    """Diagram of one need's route; a route has as many nodes as the need has modules, and some more."""
    found = nodes.where(F.col("need_id") == need).orderBy("node_id").collect()
    links = edges.where(F.col("need_id") == need).orderBy("source", "target").collect()
    return diagram("route", [(r.node_id, f"{r.node_id} {r.name}") for r in found], [(e.source, e.target) for e in links])
