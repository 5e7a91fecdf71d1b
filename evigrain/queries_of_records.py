"""Queries over operators that work on records, states, layouts and texts, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import catalog, evidence, layout, matching, metrics, needs, profiles, retrieval, solutions, structured
from .operators.shared import shared_path, top_k
from .plans import answers, filters, service, workflow
from .registry import query, table
from .sources import files
from .sources.ontology import Ontology

EMPTY = "array<string>"


def _strings(*values) -> F.Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast(EMPTY)


# --- retrieval under filters, matching ------------------------------------------------------------------

MEASURES = {"metrics": [{"metric_id": "size", "aliases": ["size"], "canonical_unit": "mm", "directions": [], "units": [{"symbol": "mm", "aliases": [], "scale": 1.0}, {"symbol": "cm", "aliases": [], "scale": 10.0}]}]}


@query(
    """with c as (select vec_id as chunk_id, embedding::double[] as e, label, text, lang from embeddings join documents on doc_id = vec_id where lang = 'en' and label in (1, 2, 3) and vec_id % 50 >= 10),
q as (select item_id as query_id, v.embedding::double[] as q, b.text from benchmark b join embeddings v on vec_id = item_id where item_id % 100 = 0),
d as (select chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:[._+/-][a-z0-9]+)*') as terms from c),
s as (select count(*) as n, avg(len(terms)) as mean from d),
qt as (select query_id, term, count(*) as times from (select query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[._+/-][a-z0-9]+)*')) as term from q) group by all),
p as (select chunk_id, length, term, count(*) as tf from (select chunk_id, len(terms) as length, unnest(terms) as term from d) where term in (select term from qt) group by all),
f as (select term, count(*) as df from p group by term),
bs as (select query_id, chunk_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) as score from p join f using (term) join qt using (term), s group by all),
bm as (select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, cast(chunk_id as varchar)) as rank from bs),
ds as (select query_id, chunk_id, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) as score from c, q),
de as (select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, cast(chunk_id as varchar)) as rank from ds),
u as (select query_id, chunk_id, 1.0::double / (60 + rank) as w from bm where rank <= 50 union all select query_id, chunk_id, 1.0::double / (60 + rank) from de where rank <= 50),
g as (select query_id, chunk_id, sum(w) as score from u group by all)
select query_id, chunk_id, round(score, 9) as score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by round(score, 12) desc, cast(chunk_id as varchar)) as rank from g) where rank <= 10"""
)
def hybrid_filtered(spark, d):
    """Fused ranking under a filter of direction, sections and a number (top-k report)."""
    v, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    section = F.when(F.col("label") == 1, "results").when(F.col("label") == 2, "method").when(F.col("label") == 3, "intro").otherwise("ack")
    chunks = v.join(docs, v["vec_id"] == docs["doc_id"]).select(F.col("vec_id").alias("chunk_id"), "embedding", "text", F.when(F.col("lang") == "en", "x").otherwise("y").alias("direction"), section.alias("section_type"))
    records = chunks.select("chunk_id", F.lit("size").alias("definition_id"), F.lit("mm").alias("canonical_unit"), F.lit("measured").alias("evidence_level"), F.lit("").alias("test_condition"), F.lit("point").alias("value_type"), (F.col("chunk_id") % 50).cast("double").alias("normalized_value"), F.lit(None).cast("double").alias("normalized_min"), F.lit(None).cast("double").alias("normalized_max"))
    raw = {"direction": "x", "section_types": ["results", "method", "intro"], "metrics": [{"definition_id": "size", "operator": "gte", "value": 1, "unit": "cm"}]}
    plan = filters.plan(raw, Ontology.read(MEASURES), {"x", "y"}, records)
    b = table(spark, d, "benchmark").where("item_id % 100 = 0")
    queries = b.join(v, b["item_id"] == v["vec_id"]).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "embedding")
    rows = plan.apply(chunks)
    both = {"dense": retrieval.dense_search(rows, queries, 50), "bm25": retrieval.bm25_search(rows, queries, 50, tokenizer=tx.latin_tokens)}
    return retrieval.reciprocal_rank_fusion(both, 10).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query(
    """with v as (select vec_id, label, embedding::double[] as e from embeddings), n as (select vec_id as need_id, e as q from v where vec_id % 100 = 0),
s as (select need_id, label as teacher, vec_id, round(least(1, greatest(0, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))))), 9) as s from v, n),
r as (select *, row_number() over (partition by need_id, teacher order by s desc, vec_id) as k, row_number() over (partition by need_id, teacher order by s desc, cast(vec_id as varchar)) as t from s),
m as (select need_id, teacher, avg(s) filter (where k <= 3) as sem, max(s) as best, count(*) filter (where t <= 4 and s >= 0.2) as ev from r group by all),
p as (select need_id, teacher, sem, case when need_id % 200 = 0 then 0 else best end as dom, case when best >= 0.3 then 1.0 else 0.0 end as cov, least(1.0, ev / 4.0) as paper, best from m),
z as (select need_id, teacher, round(100 * (0.45 * sem + 0.25 * cov + 0.15 * dom + 0.15 * paper), 2) as score, cast(cov as bigint) as matches, cast(1 - cov as bigint) as gaps from p)
select need_id, teacher, score, matches, gaps, cast(row_number() over (partition by need_id order by score desc, teacher) as integer) as rank from z"""
)
def teacher_match(spark, d):
    """Needs with ids divisible by 100 against all labels as teachers: four parts, the score, the rank."""
    v = table(spark, d, "embeddings")
    item = F.struct(F.col("vec_id").cast("string").alias("name"), F.col("embedding").cast("array<double>").alias("vector"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", item.alias("x")))), lambda p: p["x"])
    people = v.groupBy(F.col("label").cast("string").alias("teacher")).agg(own.alias("items")).select("teacher", "items", F.col("items").alias("technologies"), F.col("items").alias("applications"))
    needed = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("need_id"), F.col("embedding").cast("array<double>").alias("vector"))
    needed = needed.withColumn("domain_vector", F.when(F.col("need_id") % 200 != 0, F.col("vector"))).withColumn("capabilities", F.array(F.struct(F.lit("c").alias("name"), F.col("vector").alias("vector"))))
    chunks = v.select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("teacher"), F.lit("t").alias("text"))
    shown = retrieval.paper_evidence(chunks, needed.select(F.col("need_id").alias("query_id"), F.col("vector").alias("embedding")), "teacher", 4, 0.2).withColumnRenamed("query_id", "need_id")
    got = matching.match(needed, people, shown, 4, 0.3)
    return got.select("need_id", F.col("teacher").cast("int").alias("teacher"), "score", "matches", "gaps", "rank")


@query(
    """with v as (select vec_id, label, embedding::double[] as e from embeddings), z as (select label, case when count_if(vec_id % 30 = 26) > 0 then 25 else 99 end as last from embeddings group by 1), q as (select case vec_id when 0 then 'a' else 'b' end as field, e as q from v where vec_id in (0, 1)),
s as (select field, label, vec_id, round(least(1, greatest(0, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))))), 9) as s from v, q),
n as (select *, row_number() over (partition by field, label order by s desc, cast(vec_id as varchar)) as r from s),
g as (select field, label, vec_id, row_number() over (partition by field, label order by r) as rank from n join z using (label) where r <= 10 and vec_id % 4 <> 0 and vec_id % 30 <> 26 and vec_id % 30 <= last),
t as (select label, vec_id, min((rank, field)) as turn, string_agg(field, ',' order by rank, field) as matched_fields from g where rank <= 2 group by all)
select cast(label as varchar) as file_name, vec_id as chunk_id, matched_fields, format('S{:02d}', place) as source_label from (select *, row_number() over (partition by label order by turn, vec_id) as place from t) where place <= 3"""
)
def capability_evidence(spark, d):
    """Usable evidence of each label's vectors for two fields that choose in turn, two each, three in all."""
    v = table(spark, d, "embeddings")
    bad = F.col("vec_id") % 4 == 0
    # page 20 begins the references, so that the main text ends at page 25
    page = F.when(F.col("vec_id") % 30 == 26, 20).otherwise(F.col("vec_id") % 30)
    text = F.when(F.col("vec_id") % 30 == 26, "参考文献 [1] x").when(bad, "我要感谢").otherwise("body")
    chunks = v.select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("file_name"), text.alias("text"), F.col("vec_id"), page.cast("int").alias("page_start"), F.when(F.col("vec_id") % 30 == 26, 25).otherwise(page).cast("int").alias("page_end"))
    fields = v.where("vec_id in (0, 1)").select(F.when(F.col("vec_id") == 0, "a").otherwise("b").alias("query_id"), "embedding")
    got = evidence.capability_evidence(chunks, fields, ["a", "b"], 2, 3)
    return got.select("file_name", "chunk_id", F.array_join("matched_fields", ",").alias("matched_fields"), "source_label")


# --- metric records -------------------------------------------------------------------------------------


def _records(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    level = F.when(F.col("l_returnflag") == "R", "measured").when(F.col("l_returnflag") == "A", "reported").otherwise("inferred")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("metric_id"), F.concat(F.lit("m"), F.col("l_linenumber")).alias("definition_id"), F.lit("u").alias("canonical_unit"), F.when(F.col("l_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("c"), F.col("l_suppkey"), F.lit("-"), F.col("l_partkey"))).alias("test_condition"), level.alias("evidence_level"), "l_shipdate", "l_orderkey")


@query(
    "select concat('m', l_linenumber) as definition_id, count(*) as metrics, count_if(l_returnflag = 'R') as measured, count_if(l_returnflag = 'A') as reported, count_if(l_returnflag not in ('R', 'A')) as inferred, count_if(l_orderkey % 4 = 0) as without_condition from lineitem group by 1"
)
def metric_summary(spark, d):
    return metrics.summary(_records(spark, d), ["definition_id"])


@query(
    """with r as (select l_orderkey || '-' || l_linenumber as id, l_linenumber as m, l_suppkey || '-' || l_partkey as c, l_orderkey % 4 = 0 as unsaid from lineitem),
g as (select *, min(id) over (partition by m, c) as group_id, count(*) over (partition by m, c) as members from r where not unsaid)
select 'm' || m as definition_id, id as metric_id, group_id, members, members - 1 as n_links from g union all select 'm' || m, id, id, 1, 0 from r where unsaid"""
)
def comparable_records(spark, d):
    """Every record with its group of the same metric, unit and said condition, and the number of others there."""
    return metrics.comparable_links(_records(spark, d)).select("definition_id", "metric_id", "group_id", "members", "n_links")


@query(
    """select p_partkey, case p_partkey % 4 when 0 then '50 V偏压' when 1 then '室温' when 2 then '剂量变化' else '' end as test_condition, p_size * 10.0::double as normalized_value, case p_partkey % 4 when 3 then '<=' else '=' end as operator from part"""
)
def metric_conditions(spark, d):
    """Conditions that stand right before or right after a value."""
    n, size = F.col("p_partkey") % 4, F.concat(F.col("p_size").cast("string"), F.lit(" cm"))
    text = F.when(n == 0, F.concat(F.lit("在50 V偏压条件下，size为"), size)).when(n == 1, F.concat(F.lit("size为"), size, F.lit("，在室温下测得"))).when(n == 2, F.concat(F.lit("size为"), size, F.lit("，当剂量变化时"))).otherwise(F.concat(F.lit("在别处，size不超过"), size))
    chunks = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("chunk_id"), F.lit("p").alias("paper_id"), F.lit("unclassified").alias("direction"), F.lit("results").alias("section_type"), F.concat(text, F.lit("。")).alias("text"))
    got = metrics.extract(chunks, Ontology.read(MEASURES))
    return got.select(F.col("chunk_id").cast("long").alias("p_partkey"), "test_condition", "normalized_value", "operator")


# --- structured answers, needs, edits -------------------------------------------------------------------


def _extractions(spark, d) -> DataFrame:
    n = F.col("p_partkey") % 5
    proof = F.when(n == 2, '"S09"').when(n == 4, "").otherwise('"S01", "S02"')
    body = F.concat(F.lit('{"research_problem": " a  b ", "materials": ["m", "m"'), F.when(n == 1, ', "extra"').otherwise(""), F.lit('], "evidence_map": [{"field": "research_problem", "claim": "a b", "source_labels": ["S01"]}, {"field": "materials", "claim": "m", "source_labels": ['), proof, F.lit("]}]}"))
    answer = F.when(n == 3, F.concat(F.lit("Here it is: "), body)).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return table(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), answer.alias("answer"), _strings("S01", "S02").alias("labels"))


@query("select p_partkey as paper_id, case p_partkey % 5 when 1 then 'a claim without evidence' when 2 then 'an unknown label' when 3 then 'no JSON object' when 4 then 'evidence without labels' end as problem from part")
def extraction_checks(spark, d):
    """Structured answers, with what is wrong with each."""
    return structured.parse_extractions(_extractions(spark, d)).select("paper_id", "problem")


@query(
    """with x as (select p_partkey as paper_id, p_size from part where p_partkey % 5 = 0)
select paper_id, field, claim, string_agg(label || ':c' || p_size, ',' order by label) as sources from (select *, 'materials' as field, 'm' as claim, unnest(['S01', 'S02']) as label from x union all select *, 'research_problem', 'a b', 'S01' from x) group by all"""
)
def claim_sources(spark, d):
    """Labels of valid answers resolved to chunks."""
    shown = table(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), F.explode(_strings("S01", "S02", "S03")).alias("source_label"), F.concat(F.lit("c"), "p_size").alias("chunk_id"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"))
    got = structured.resolve_sources(structured.parse_extractions(_extractions(spark, d)), shown)
    return got.select("paper_id", "field", "claim", F.array_join(F.transform("sources", lambda s: F.concat(s["source_label"], F.lit(":"), s["chunk_id"])), ",").alias("sources"))


@query("select p_partkey as paper_id, case p_partkey % 4 when 0 then 'an unknown label' when 1 then 'a claim without labels' when 2 then 'a reading that doesn''t cite its object' end as problem, case when p_partkey % 4 = 3 then 8 end as findings from part")
def reading_checks(spark, d):
    """Deep readings, with what is wrong with each; lists are cut at eight."""
    n = F.col("p_partkey") % 4
    one = lambda labels: f'{{"claim": "c", "source_labels": [{labels}]}}'
    found = F.when(n == 0, one('"E9"')).when(n == 1, one("")).when(n == 3, ", ".join([one('"E1"')] * 10)).otherwise("")
    figure = F.when(n == 2, '{"asset_id": "F1", "observation": "o", "source_labels": ["E1"]}').otherwise("")
    answer = F.concat(F.lit('{"key_findings": ['), found, F.lit('], "figure_interpretations": ['), figure, F.lit("]}"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), answer.alias("answer"), _strings("E1").alias("evidence_labels"), _strings("F1").alias("figure_labels"), _strings().alias("formula_labels"))
    return structured.parse_readings(rows).select("paper_id", "problem", F.when(F.col("problem").isNull(), F.size("reading.key_findings")).alias("findings"))


@query(
    """select c_custkey as need_id, 'p' || c_custkey as product, case when c_custkey % 2 = 0 then 'k,new' else 'k' end as capabilities, case when c_custkey % 3 = 0 then 'raw:enterprise_original' else '成本 <= 2 c:enterprise_user_edit' end as metrics,
  case when c_custkey % 2 = 0 then 'orig,new' else 'orig' end as phrases from customer"""
)
def edited_needs(spark, d):
    """Edits of needs: lists cleaned, metrics matched by all their parts, evidence rebuilt."""
    n = F.col("c_custkey")
    metric = F.struct(F.lit("TM01").alias("metric_id"), F.lit("成本").alias("name"), F.lit("<=").alias("operator"), F.lit("1").alias("value_text"), F.lit("").alias("unit"), F.lit("c").alias("test_condition"), F.lit("raw").alias("raw_text"))
    none = {f: _strings().alias(f) for f in structured.EDITABLE if f != "required_capabilities"}
    proof = F.array(F.struct(F.lit("required_capabilities").alias("field"), F.lit("k").alias("value"), _strings("orig").alias("phrases")))
    rows = table(spark, d, "customer").select(n.alias("need_id"), F.lit("i").alias("industry"), F.lit("p").alias("product"), *none.values(), _strings("k").alias("required_capabilities"), F.array(metric).alias("target_metrics"), proof.alias("evidence_map"))
    given = F.struct(F.lit("成本").alias("name"), F.lit("<=").alias("operator"), F.when(n % 3 == 0, "1").otherwise("2").alias("value_text"), F.lit("").alias("unit"), F.lit("c").alias("test_condition"))
    edits = table(spark, d, "customer").select(n.alias("need_id"), F.lit(" ").alias("industry"), F.concat(F.lit(" p"), n).alias("product"), *none.values(), F.when(n % 2 == 0, _strings("k", "K ", " new")).otherwise(_strings("k", " ")).alias("required_capabilities"), F.array(given).alias("metrics"))
    got = structured.apply_edits(rows, edits)
    own = F.filter("evidence_map", lambda e: e["field"] == "required_capabilities")
    return got.select("need_id", "product", F.array_join("required_capabilities", ",").alias("capabilities"), F.array_join(F.transform("target_metrics", lambda m: F.concat(m["raw_text"], F.lit(":"), m["provenance_type"])), ",").alias("metrics"), F.array_join(F.flatten(F.transform(own, lambda e: e["phrases"])), ",").alias("phrases"))


@query(
    """select c_custkey as need_id, case when c_custkey % 4 = 0 then 'an empty request' end as error, case when c_custkey % 4 = 0 then '' when c_custkey % 2 = 0 then '天气很好,第' || c_custkey || '号' else '第' || c_custkey || '号' end as unparsed,
  case when c_custkey % 4 = 0 then '' else '已有样机' end as foundations from customer"""
)
def unparsed_requests(spark, d):
    """Clauses of requests that no rule reads, and empty requests as errors of their rows."""
    n = F.col("c_custkey")
    text = F.when(n % 4 == 0, "  \n ").otherwise(F.concat(F.when(n % 2 == 0, "天气很好。").otherwise(""), F.lit("需要低成本方案；第"), n, F.lit("号，已有样机。")))
    got = needs.parse(table(spark, d, "customer").select(n.alias("need_id"), text.alias("request_text")))
    return got.select("need_id", "error", F.array_join("unparsed_fragments", ",").alias("unparsed"), F.array_join("existing_foundations", ",").alias("foundations"))


@query("select c_custkey as need_id, 'req' || chr(10) || case when c_custkey % 2 = 0 then '行业：' || c_mktsegment || chr(10) else '' end || '产品：p' || chr(10) || '技术问题：a；b' as query from customer")
def need_texts(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("need_id"), F.lit("req").alias("original_request"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("industry"), F.lit("p").alias("product"), _strings("a", "b").alias("technical_problems"), _strings().alias("required_capabilities"), _strings().alias("constraints"), _strings().alias("keywords"))
    return rows.select("need_id", workflow.need_query().alias("query"))


@query("select p_brand as teacher, 'core_capabilities' as profile_field, 'extra' as value from part group by 1 union all select p_brand, 'core_capabilities', 'v' || p_size from part where p_size % 10 = 0 group by p_brand, p_size")
def unsupported_values(spark, d):
    """Profile values without evidence, and evidence without a value."""
    p = table(spark, d, "part")
    both = p.select(F.col("p_brand").alias("teacher"), F.lit("core_capabilities").alias("profile_field"), F.concat(F.lit("v"), "p_size").alias("value"), "p_size").distinct()
    more = p.select(F.col("p_brand").alias("teacher"), F.lit("core_capabilities").alias("profile_field"), F.lit("extra").alias("value")).distinct()
    return profiles.unsupported(both.drop("p_size").unionByName(more), both.where("p_size % 10 <> 0").drop("p_size"))


# --- solutions ------------------------------------------------------------------------------------------


@query(
    """select c_custkey as need_id, case when c_custkey % 3 = 0 or c_custkey % 5 = 0 or c_custkey % 4 = 0 then 'needs_review' else 'passed' end as status, cast(case when c_custkey % 3 = 0 then 0 else 1 end as bigint) as paper_evidence_count,
  array_to_string(list_filter([case when c_custkey % 3 = 0 then 'no evidence from papers' end, case when c_custkey % 3 <> 0 and c_custkey % 5 = 0 then 'evidence of another teacher' end, case when c_custkey % 4 = 0 then 'a technology without a source' end], lambda x: x is not null), ',') as issues from customer"""
)
def evidence_review(spark, d):
    """Three rules on the evidence of each recommendation."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("need_id"), F.lit("Li").alias("teacher"))
    shown = c.where("need_id % 3 <> 0").withColumn("evidence_teacher", F.when(F.col("need_id") % 5 == 0, "Wu").otherwise("Li"))
    told = spark.createDataFrame([("Li", "good", 2), ("Li", "mixed", 1), ("Li", "mixed", 0)], "teacher string, item string, sources int")
    skills = c.select("need_id", "teacher", F.when(F.col("need_id") % 4 == 0, F.when(F.col("need_id") % 8 == 0, "unknown").otherwise("mixed")).otherwise("good").alias("item"))
    got = solutions.review(c, shown, skills, told)
    return got.select("need_id", "status", "paper_evidence_count", F.array_join("issues", ",").alias("issues"))


@query(
    """select c_custkey as need_id, case c_custkey % 5 when 0 then 'a phrase that is not in the request' when 1 then 'a supported module without evidence' when 2 then 'evidence that lacks a field' when 3 then 'a route with a cycle' end as problem, case when c_custkey % 5 = 3 then unnest(['R01', 'R02']) else 'M01' end as about
from customer where c_custkey % 5 = 3 union select c_custkey, case c_custkey % 5 when 0 then 'a phrase that is not in the request' when 1 then 'a supported module without evidence' else 'evidence that lacks a field' end, 'M01' from customer where c_custkey % 5 < 3"""
)
def bundle_checks(spark, d):
    """Solutions that can't be traced to a request, to evidence, or along a route."""
    n = F.col("c_custkey")
    c = table(spark, d, "customer")
    prof = c.select(n.alias("need_id"), F.lit("Low cost please").alias("original_request"), F.array(F.struct(F.lit("f").alias("field"), F.lit("cheap").alias("value"), F.array(F.when(n % 5 == 0, "huge").otherwise("low COST")).alias("phrases"))).alias("evidence_map"))
    shown = F.array(F.struct(F.lit(1).alias("rank"), F.when(n % 5 != 2, "c").alias("chunk_id"), F.lit(0.5).alias("similarity")))
    sup = c.select(n.alias("need_id"), F.lit("M01").alias("module_id"), F.lit("cheap").alias("name"), F.lit(True).alias("supported"), F.when(n % 5 != 1, shown).alias("evidence"))
    nodes = c.select(n.alias("need_id"), F.explode(_strings("R01", "R02")).alias("node_id"))
    ways = F.array(F.struct(F.lit("R01").alias("source"), F.lit("R02").alias("target")), F.struct(F.when(n % 5 == 3, "R02").otherwise("R01").alias("source"), F.when(n % 5 == 3, "R01").otherwise("R02").alias("target")))
    edges = c.select(n.alias("need_id"), F.explode(ways).alias("e")).select("need_id", "e.*")
    return solutions.invalid_bundles(prof, sup, edges, nodes)


@query("select c_custkey as need_id, 'L0' || i as milestone_id, 'R0' || i as node_id, case when i = 1 and c_custkey % 2 = 0 then 'pause_for_evidence' end as blocked_by from customer, (select unnest([1, 2, 3]) as i)")
def landing_plan(spark, d):
    c = table(spark, d, "customer")
    nodes = c.select(F.col("c_custkey").alias("need_id"), F.explode(_strings("R01", "R02", "R03")).alias("node_id")).withColumn("name", F.lit("n"))
    said = c.select(F.col("c_custkey").alias("need_id"), F.when(F.col("c_custkey") % 2 == 0, "pause_for_evidence").otherwise("proceed_to_feasibility").alias("decision"))
    return solutions.landing_plan(nodes, said).drop("name")


@query("select p_partkey % 97 as file, p_partkey as chunk_id, case p_partkey % 3 when 0 then 'unknown chunk' when 1 then 'pages outside the chunk' end as problem from part where p_partkey % 3 < 2 union all select p_partkey % 97, p_partkey, 'chunk of another paper' from part where p_partkey % 3 = 2 and p_partkey % 5 = 0")
def source_problems(spark, d):
    """Cited sources that no chunk bears out."""
    p = table(spark, d, "part")
    n = F.col("p_partkey")
    source = F.struct(n.cast("string").alias("chunk_id"), F.lit(2).alias("page_start"), F.when(n % 3 == 1, 9).otherwise(3).alias("page_end"))
    proof = F.array(F.struct(F.lit("f").alias("field"), F.lit("c").alias("claim"), F.array(source).alias("sources")))
    records = p.select((n % 97).alias("file"), F.struct(F.concat(F.lit("f"), n % 97).alias("file_name")).alias("paper"), proof.alias("evidence_map"))
    chunks = p.where("p_partkey % 3 <> 0").select(n.cast("string").alias("chunk_id"), F.when((n % 3 == 2) & (n % 5 == 0), "other").otherwise(F.concat(F.lit("f"), n % 97)).alias("file_name"), F.lit(1).alias("page_start"), F.lit(4).alias("page_end"))
    return evidence.source_problems(records, chunks, "file").withColumn("chunk_id", F.col("chunk_id").cast("long"))


# --- layout ---------------------------------------------------------------------------------------------


@query(
    """with n as (select p_partkey, p_size % 5 + 1 as k from part),
a as (select p_partkey, i + 1 as no, '绪论' as section_path, 'intro' as section_type, least(2, k - 2 * i) * 201 - 1 as characters, 2 + 2 * i as block_start, least(k + 1, 3 + 2 * i) as block_end, 1 as page_start, ceil(k / 2.0) as before from n, unnest(range(0, 3)) as r(i) where 2 * i < k),
b as (select p_partkey, cast(ceil(k / 2.0) as bigint) + i + 1 as no, '绪论 > Parts' as section_path, 'intro' as section_type, case i when 0 then 11 when 3 then 260 else 450 end as characters, case i when 0 then 2 else 3 end as block_start, case i when 0 then 2 else 3 end as block_end, 2 as page_start from n, unnest(range(0, 4)) as r(i))
select p_partkey, format('d{}_chunk_{:04d}', p_partkey, no) as chunk_id, section_path, section_type, cast(characters as integer) as characters, cast(page_start as integer) as page_start, cast(block_start as integer) as block_start, cast(block_end as integer) as block_end
from (select p_partkey, no, section_path, section_type, characters, block_start, block_end, page_start from a union all select * from b)"""
)
def chunk_outline(spark, d):
    """Documents with a table of contents: sections bound chunks, captions are alone, long blocks are split and overlap."""
    block = lambda i, kind, text: F.struct(i.alias("block_number"), F.lit(kind).alias("block_type"), text.alias("text"))
    k = F.col("p_size") % 5 + 1
    body = F.transform(F.sequence(F.lit(1), k), lambda i: block(i + 1, "paragraph", F.lit("y" * 200)))
    first = F.concat(F.array(block(F.lit(1), "paragraph", F.lit(" 绪 论"))), body)
    second = F.array(block(F.lit(1), "paragraph", F.lit("parts")), block(F.lit(2), "figure_caption", F.lit("Figure 1  x")), block(F.lit(3), "paragraph", F.lit("z" * 1000)))
    page = lambda n, blocks: F.struct(F.lit(n).alias("page"), F.lit("").alias("text"), blocks.alias("blocks"))
    toc = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(title).alias("title"), F.lit(p).alias("page")) for level, title, p in ((1, "绪论", 1), (2, "Parts", 2))])
    docs = table(spark, d, "part").select(F.concat(F.lit("d"), "p_partkey", F.lit(".pdf")).alias("file_name"), F.array(page(1, first), page(2, second)).alias("pages"), toc.alias("toc"))
    got = layout.chunk_documents(docs)
    return got.select(F.regexp_extract("file_name", r"\d+", 0).cast("long").alias("p_partkey"), "chunk_id", "section_path", "section_type", F.length("text").alias("characters"), "page_start", "block_start", "block_end")


@query(
    """with k as (select source as file_name, doc_id, row_number() over (partition by source order by md5('7:' || doc_id), doc_id) as n from documents where text is not null),
t as (select file_name, array_to_string(list(doc_id order by doc_id), ',') as samples from k where n <= 3 group by 1)
select source as file_name, cast(sum(length(text)) as bigint) as characters, count(*) as chunks, round(avg(length(text)), 6) as mean_length, samples
from documents join t on file_name = source where text is not null group by source, samples"""
)
def chunk_stats(spark, d):
    """Sizes by group, and three of its chunks, chosen by a seed."""
    docs = table(spark, d, "documents").withColumnRenamed("source", "file_name").where("text is not null")
    got = layout.chunk_summary(docs, ["file_name"], 3, 7, "doc_id").withColumn("mean_length", F.round("mean_length", 6))
    return got.withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))


@query("select event_type as paper_id, count(distinct user_id) as pages, count(*) as blocks, count_if(event_id % 3 = 0) as figures, count_if(event_id % 3 = 1) as tables, cast(sum(event_id % 4) as bigint) as scripts from events group by 1")
def layout_audit(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "figure_caption").when(F.col("event_id") % 3 == 1, "table_caption").otherwise("paragraph")
    return layout.layout_audit(e.select(F.col("event_type").alias("paper_id"), F.col("user_id").alias("page"), kind.alias("block_type"), (F.col("event_id") % 4).alias("script_span_count")), ["paper_id"])


@query("select p_partkey as line, case p_partkey % 3 when 0 then '10^{-' || p_size || '} cm' when 1 then 'x_{' || p_size || '} cm' else 'x' || p_size || ' cm' end as text, cast(case when p_partkey % 3 < 2 then 1 else 0 end as bigint) as scripts from part")
def script_lines(spark, d):
    """Spans of lines put together: raised and lowered small ones are scripts, wide gaps are blanks."""
    n, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    span = lambda i, text, size_, x0, x1, y: F.struct(F.lit(i).alias("o"), text.alias("text"), size_.alias("size"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), y.alias("y"))
    small = F.when(n == 2, 10.0).otherwise(6.0)
    y = F.when(n == 0, 96.0).when(n == 1, 103.0).otherwise(100.0)
    spans = F.array(span(1, F.when(n == 0, "10").otherwise("x"), F.lit(10.0), 0.0, 10.0, F.lit(100.0)), span(2, F.when(n == 0, F.concat(F.lit("-"), size)).otherwise(size), small, 10.0, 14.0, y), span(3, F.lit("cm"), F.lit(10.0), 20.0, 30.0, F.lit(100.0)))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("line"), F.explode(spans).alias("s")).select("line", "s.*")
    return layout.render_lines(rows, ["line"], "o")


@query("select p_partkey, case when p_partkey % 3 < 2 then case p_partkey % 3 when 0 then 'figure' else 'table' end end as kind, case p_partkey % 3 when 0 then 'Fig' || p_size when 1 then '表' || p_size end as label, case p_partkey % 3 when 0 then p_name when 1 then '表 ' || p_size end as caption from part")
def caption_parse(spark, d):
    n = F.col("p_partkey") % 3
    text = F.when(n == 0, F.concat(F.lit("Fig. "), "p_size", F.lit(":  "), "p_name")).when(n == 1, F.concat(F.lit("表 "), "p_size")).otherwise(F.concat(F.lit("no "), "p_name"))
    return table(spark, d, "part").select("p_partkey", layout.caption_parts(text).alias("c")).select("p_partkey", "c.kind", "c.label", "c.caption")


@query(
    """with x as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents), y as (select doc_id, t, substring(t, 1, 60) as h from x),
z as (select *, greatest(case when contains(h, '.') then length(h) - strpos(reverse(h), '.') + 1 else 0 end, case when contains(h, ';') then length(h) - strpos(reverse(h), ';') + 1 else 0 end) as stop from y)
select doc_id, case when length(t) <= 60 then t else rtrim(case when stop - 1 >= 33 then substring(h, 1, stop) else h end, ' ') || '……' end as excerpt from z"""
)
def compact_excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.compact(F.col("text"), 60).alias("excerpt"))


@query("select p_partkey, case when p_partkey % 4 < 2 then true else false end as heading, cast(case p_partkey % 4 when 1 then 3 else 1 end as integer) as level from part")
def heading_looks(spark, d):
    n = F.col("p_partkey") % 4
    text = F.when(n == 0, "第 3 章 方法").when(n == 1, F.concat(F.lit("1.2."), "p_size", F.lit(" Setup"))).when(n == 2, F.repeat(F.lit("1 Long "), 40)).otherwise("plain words")
    level = layout.heading_level(F.when(n == 2, "x").otherwise(text))
    return table(spark, d, "part").select("p_partkey", layout.is_heading(text).alias("heading"), level.cast("int").alias("level"))


@query(
    """with c as (select source as paper_id, format('c{:09d}', doc_id) as chunk_id, text, doc_id from documents where length(regexp_replace(text, '\\s+', '', 'g')) >= 50 and doc_id % 11 <> 0),
s as (select paper_id, chunk_id, doc_id, contains(text, 'license')::int + contains(text, 'rights')::int as h1, contains(text, 'idiot')::int + contains(text, 'clown')::int as h2, doc_id % 5 = 1 as e1, doc_id % 5 = 2 as e2, doc_id % 5 = 3 as e3, cast(doc_id % 50 as integer) as page from c),
a as (select paper_id, chunk_id, row_number() over (partition by paper_id order by e1 desc, h1 desc, page, chunk_id) as k from s where e1 or h1 > 0),
a2 as (select * from a where k <= 2),
b as (select paper_id, chunk_id, row_number() over (partition by paper_id order by e2 desc, h2 desc, page, chunk_id) as k from s where (e2 or h2 > 0) and not (not e1 and not e2 and not e3 and page <= 3) and chunk_id not in (select chunk_id from a2)),
b2 as (select * from b where k <= 2),
g as (select paper_id, chunk_id, row_number() over (partition by paper_id order by page, chunk_id) as k from s where e3 and chunk_id not in (select chunk_id from a2) and chunk_id not in (select chunk_id from b2))
select paper_id, 'legal' as section, cast(k as integer) as place, chunk_id from a2 union all select paper_id, 'tone', cast(k as integer), chunk_id from b2 union all select paper_id, 'end', cast(k as integer), chunk_id from g where k <= 2"""
)
def section_evidence(spark, d):
    """Sections of each source choose their documents in order, none twice."""
    n = F.col("doc_id") % 5
    kind = F.when(F.col("doc_id") % 11 == 0, "reference").when(n == 1, "abstract").when(n == 2, "method").when(n == 3, "conclusion").otherwise("unknown")
    docs = table(spark, d, "documents").select(F.col("source").alias("paper_id"), F.format_string("c%09d", "doc_id").alias("chunk_id"), "text", kind.alias("section_type"), F.lit("").alias("section_path"), (F.col("doc_id") % 50).cast("int").alias("page_start"))
    plan = [("legal", ("abstract",), ("license", "rights")), ("tone", ("method",), ("idiot", "clown")), ("end", ("conclusion",), ())]
    return evidence.reading_evidence(docs, plan=plan)


@query("select conv_id as file_name, cast(case when conv_id % 3 = 0 and max(turn) >= 20 then greatest(10, floor(max(turn) / 2)) else max(turn) + 1 end as integer) as end_page from conversations group by 1")
def main_text_pages(spark, d):
    """The main text ends where the references begin, in the latter half."""
    c = table(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    start = F.greatest(F.lit(10), F.floor(F.col("last") / 2))
    here = (F.col("conv_id") % 3 == 0) & (F.col("last") >= 20) & (F.col("turn") >= start)
    rows = c.join(last, "conv_id").select(F.col("conv_id").alias("file_name"), F.col("turn").alias("page_start"), F.col("turn").alias("page_end"), F.when(here, "参考文献 [1] a").otherwise("x").alias("text"))
    return evidence.main_text_end(rows).withColumn("end_page", F.col("end_page").cast("int"))


# --- answers --------------------------------------------------------------------------------------------


@query("select p_partkey, p_partkey % 3 = 0 as overview from part")
def overview_questions(spark, d):
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("老师"), "p_size", F.lit("研究什么？"))).otherwise(F.concat(F.lit("研究什么"), "p_size"))
    return table(spark, d, "part").select("p_partkey", answers.is_overview(text).alias("overview"))


@query(
    """with s as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as rank from (select distinct conv_id, turn from conversations)),
t as (select *, '[' || rank || '] 《T' || turn || '》，' || case when turn % 2 = 0 then '第 ' || turn || ' 页' else '第 ' || turn || '-' || (turn + 1) || ' 页' end || '，作者：A，Chunk：' || conv_id || '-' || turn as line from s where rank <= 3)
select conv_id as question_id, string_agg(line, chr(10) order by rank) as sources, cast(count(*) as integer) as source_count, '[' || count(*) || ']' as answer from t group by 1"""
)
def grounded_answers(spark, d):
    """Numbered sources, prompts, and answers of a stand-in model whose citations are checked."""
    c = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    chunks = c.select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.concat(F.lit("T"), "turn").alias("title"), F.lit("A").alias("author"), F.lit("Li").alias("teacher"), F.lit(2020).alias("year"), F.col("turn").alias("page_start"), (F.col("turn") + F.col("turn") % 2).alias("page_end"), F.lit("x").alias("text"))
    found = top_k(c, ["conv_id"], [F.col("turn")], 3).select(F.col("conv_id").alias("question_id"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), "rank")
    asked = answers.prompts(found, chunks, c.select(F.col("conv_id").alias("question_id")).distinct().withColumn("question", F.lit(" q ")))
    model = lambda rows: rows.withColumn("answer", F.concat(F.lit("["), F.regexp_count("prompt", F.lit("Chunk ID")).cast("string"), F.lit("]")))
    got = answers.answer(asked, model)
    return got.select("question_id", F.array_join("sources", "\n").alias("sources"), "source_count", "answer")


# --- catalog states, tags, files ------------------------------------------------------------------------


def _catalog(spark, d) -> DataFrame:
    o = F.col("o_orderkey")
    state = F.when(o % 5 == 0, "parsing").when(o % 5 == 1, "indexing").when(o % 5 == 2, "failed").otherwise("metadata_pending")
    return table(spark, d, "orders").select(o.alias("paper_id"), F.col("o_orderpriority").alias("title"), F.lit("T").alias("teacher"), state.alias("ingestion_status"), F.lit("").alias("error_message"), F.lit("1").alias("created_at"), F.lit("1").alias("updated_at"))


@query("select o_orderkey as paper_id, case when o_orderkey % 7 = 0 then 'indexed' else case o_orderkey % 5 when 0 then 'metadata_pending' when 1 then 'parsed' when 2 then 'failed' else 'metadata_pending' end end as ingestion_status, case when o_orderkey % 7 = 0 then '2' else '1' end as updated_at from orders")
def status_changes(spark, d):
    """Interrupted work goes back a state, then some papers get new states."""
    papers = _catalog(spark, d)
    changes = papers.where("paper_id % 7 = 0").select("paper_id", F.lit("indexed").alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit("2").alias("at"))
    return catalog.set_status(catalog.recover(papers), changes).select("paper_id", "ingestion_status", "updated_at")


@query(
    """with t as (select p_partkey, lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) as v, sha256(p_partkey || chr(31) || 'device' || chr(31) || lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) || chr(31) || 'user') as id from part)
select p_partkey as paper_id, v as normalized_value, case when p_partkey % 2 = 0 then 0.9::double else 0.5::double end as confidence, '1' as created_at, case when p_partkey % 2 = 0 then '2' else '1' end as updated_at, id as tag_id from t"""
)
def tag_upserts(spark, d):
    """Tags by id: half of them come again with another confidence and keep their first time."""
    p = table(spark, d, "part")
    tags = lambda rows, conf, at: rows.select(F.col("p_partkey").cast("string").alias("paper_id"), F.lit("device").alias("category"), F.concat(F.lit(" "), "p_type").alias("value"), F.lit("user").alias("source"), F.lit(conf).alias("confidence"), F.lit("suggested").alias("review_status"), F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"))
    papers = p.select(F.col("p_partkey").cast("string").alias("paper_id"))
    old = catalog.with_tag_ids(tags(p, 0.5, "1"))
    got = catalog.upsert_tags(old, tags(p.where("p_partkey % 2 = 0"), 0.9, "2"), papers)
    return got.select(F.col("paper_id").cast("long").alias("paper_id"), "normalized_value", "confidence", "created_at", "updated_at", "tag_id")


@query("select p_partkey as paper_id, case p_partkey % 6 when 1 then 'the id is not the digest' when 2 then 'a name is missing' when 3 then 'unknown status' when 4 then 'year out of range' when 5 then 'a negative size' end as rule from part where p_partkey % 6 > 0")
def invalid_papers(spark, d):
    n, k = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    rows = table(spark, d, "part").select(k.alias("paper_id"), F.when(n == 1, "x").otherwise(k).alias("sha256"), F.lit("f").alias("file_name"), F.lit("p").alias("file_path"), F.when(n == 2, " ").otherwise("t").alias("title"), F.when(n == 3, "odd").otherwise("parsed").alias("ingestion_status"), F.lit("local").alias("source_type"), F.when(n == 4, 1700).otherwise(2020).alias("year"), F.lit(1).alias("page_count"), F.when(n == 5, -1).otherwise(1).alias("file_size_bytes"))
    return catalog.invalid_papers(rows).select(F.col("paper_id").cast("long").alias("paper_id"), "rule")


@query("select p_partkey as paper_id from part where contains(lower(p_name), 'a') or contains('f' || p_partkey || '.pdf', 'a') or contains(lower(p_type), 'a')")
def chosen_papers(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), F.concat(F.lit("f"), "p_partkey", F.lit(".pdf")).alias("file_name"), F.array("p_type").alias("authors"))
    return catalog.choose_papers(rows, "A").select("paper_id")


@query(
    """with x as (select doc_id, '%PDF-' || text as body, doc_id % 4 = 0 as plain, doc_id % 9 = 0 as big, sha256(case when doc_id % 4 = 0 then text else '%PDF-' || text end) as id from documents),
y as (select *, row_number() over (partition by id order by format('p{:09d}', doc_id)) as k from x)
select doc_id, case when big then 'too_large' when plain then 'not_pdf' when k > 1 or id in (select id from x where doc_id % 10 = 1) then 'duplicate' else 'accepted' end as status from y"""
)
def upload_status(spark, d):
    """Uploads judged by size, first bytes and digest, against each other and the library."""
    docs = table(spark, d, "documents")
    body = F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.concat(F.lit("%PDF-"), "text")).cast("binary")
    rows = docs.select("doc_id", F.format_string("p%09d", "doc_id").alias("path"), F.when(F.col("doc_id") % 9 == 0, files.MAX_UPLOAD + 1).otherwise(10).cast("long").alias("length"), body.alias("content"))
    known = rows.where("doc_id % 10 = 1").select(F.sha2("content", 256).alias("paper_id"))
    return files.accept_uploads(rows, known).select("doc_id", "status")


@query("select sha256('%PDF-' || text) as paper_id, min(format('p{:09d}', doc_id)) as path from documents group by 1")
def registered_files(spark, d):
    rows = table(spark, d, "documents").select(F.format_string("p%09d", "doc_id").alias("path"), F.concat(F.lit("%PDF-"), "text").cast("binary").alias("content"))
    return catalog.register(rows).select("paper_id", "path")


@query("select p_partkey, case when p_partkey % 2 = 0 then p_brand else '' end as owner from part")
def file_owners(spark, d):
    path = F.concat(F.lit("s3://x/lib/"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_brand"), F.lit("/in/"))).otherwise(""), F.col("p_partkey"), F.lit(".pdf"))
    return table(spark, d, "part").select("p_partkey", files.owner_of(path, "s3://x/lib/").alias("owner"))


@query("select doc_id as paper_id, 'licence' as value, round(0.94, 2)::double as confidence, 0 as page from documents where contains(lower(text), 'license')")
def content_tags(spark, d):
    rules = [{"category": "topic", "value": "licence", "keywords": ["License", "LICENSED"], "confidence": 0.9}]
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.explode(F.array(*[F.struct(F.lit(p).alias("page"), F.col("text").alias("text")) for p in (0, 1)])).alias("p")).select("paper_id", "p.*")
    return catalog.content_tags(pages, rules).select("paper_id", "value", F.round("confidence", 2).alias("confidence"), "page")


@query("select o_orderstatus as kind, count(*) as n, max(o_totalprice) as most from orders group by 1")
def partitioned_write(spark, d):
    """Rows written by key, as compressed JSON, and read again; a second installation at a path is refused."""
    path = shared_path(spark, "partitioned")
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), "o_totalprice")
    files.write_partitioned(rows, path, "kind")
    back = spark.read.schema("o_totalprice double, kind string").json(path)
    return back.groupBy("kind").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))


@query("select item_id as query_id, text as query from benchmark")
def query_files(spark, d):
    """Queries written as JSON lines and read by the checked reader."""
    path = shared_path(spark, "queries")
    table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query")).write.json(path)
    return files.queries(spark, path).select(F.col("query_id").cast("long").alias("query_id"), "query")


@query("select 'v' || c_custkey as version_id, case when c_custkey % 2 = 0 then 'v' || c_custkey || 'b' end as child, sha256('{\"n\": ' || c_custkey || '}') as profile_sha256 from customer")
def saved_versions(spark, d):
    """Versions with digests, half of them with a confirmed child; all are read back and checked."""
    n = F.col("c_custkey")
    body = F.concat(F.lit('{"n": '), n, F.lit("}"))
    row = lambda rows, name, parent, status: rows.select(name.alias("version_id"), n.cast("string").alias("need_id"), parent.cast("string").alias("parent_version_id"), F.lit(status).alias("status"), F.lit("1").alias("saved_at"), F.lit(None).cast("string").alias("profile_sha256"), body.alias("profile"))
    c, first = table(spark, d, "customer"), F.concat(F.lit("v"), n)
    old = files.new_versions(spark.createDataFrame([], files.VERSION), row(c, first, F.lit(None), "system_parsed"))
    new = files.new_versions(old, row(c.where("c_custkey % 2 = 0"), F.concat(first, F.lit("b")), first, "confirmed_by_user"))
    path = shared_path(spark, "versions")
    old.unionByName(new).write.json(path)
    saved = files.versions(spark, path)
    child = saved.where("parent_version_id is not null").select(F.col("parent_version_id").alias("version_id"), F.col("version_id").alias("child"))
    return saved.where("parent_version_id is null").select("version_id", "profile_sha256").join(child, "version_id", "left")


@query("select count(distinct sha256(text)) as rows_kept, 0 as again from documents")
def stream_resumed(spark, d):
    """A stream worked off twice: the second time nothing is new."""
    from .streaming import ingest

    path, out = f"{d}/documents.parquet", shared_path(spark, "resumed")
    schema = spark.read.parquet(path).schema
    kept = lambda: ingest.once_per_content(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(path).select("text"), ["text"]).select("content_id")
    count = lambda: spark.read.schema("content_id string").parquet(f"{out}/rows").agg(F.count("*").alias("n"))
    ingest.run_available(kept(), f"{out}/rows", f"{out}/checkpoint")
    first = count().first()["n"]
    ingest.run_available(kept(), f"{out}/rows", f"{out}/checkpoint")
    return count().select(F.col("n").alias("rows_kept"), (F.col("n") - F.lit(first)).cast("int").alias("again"))


# --- service --------------------------------------------------------------------------------------------


@query(
    """with p as (select p_partkey, p_brand, p_name, case when p_size > 25 then 'indexed' else 'parsed' end as s from part),
f as (select p_brand as k, count(*) as n from p group by 1 order by n desc, lower(k) limit 200)
select 'health' as part, 'papers' as name, cast(count(*) as varchar) as value from p union all select 'stats', s, cast(count(*) as varchar) from p group by s union all select 'stats', 'owners', cast(count(distinct p_brand) as varchar) from p
union all select 'teachers', k, cast(n as varchar) from f union all select 'teachers', '(total)', cast(count(distinct p_brand) as varchar) from p
union all select 'page', cast(p_partkey as varchar), p_name from (select * from p order by lower(p_brand), lower(p_name), p_partkey limit 18 offset 18) union all select 'detail', cast(p_partkey as varchar), p_name from p where p_partkey = 1"""
)
def service_answers(spark, d):
    """What the catalog service answers to health, stats, teachers, the second page and a paper (paging is the feature)."""
    papers = table(spark, d, "part").select(
        F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), F.concat(F.lit("f"), "p_partkey", F.lit(".pdf")).alias("file_name"), F.col("p_brand").alias("teacher"), F.array("p_type").alias("authors"),
        F.array().cast(EMPTY).alias("keywords"), F.lit("unclassified").alias("direction"), F.when(F.col("p_size") > 25, "indexed").otherwise("parsed").alias("ingestion_status"), F.col("p_size").alias("year"),
    )
    tags = spark.createDataFrame([], "paper_id long, category string, value string, normalized_value string, confidence double, review_status string")
    return service.answers(papers, tags, 2, 1)


# --- PDF files ------------------------------------------------------------------------------------------


def _pdf_files(docs):
    """(path, content): a PDF of each document, a page a line, its lines' first words as bookmarks below its source; some
    are encrypted, some lack their trailer, some their head."""
    obj = lambda n, body: F.concat(n.cast("string"), F.lit(" 0 obj\n<< "), *body, F.lit(" >>\nendobj\n"))
    text = lambda *parts: [F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts]
    page, mark = (lambda i: F.lit(10) + i * 2), (lambda i: F.lit(11) + i * 2)
    lines = F.split("text", "\n")
    rows = docs.select("doc_id", "source", F.transform(lines, lambda x: F.regexp_extract(F.lower(x), tx.LATIN_TOKEN, 0)).alias("titles"))
    rows = rows.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("titles") - 1), lambda i: F.element_at("titles", i + 1) != ""))
    some, at, n = F.size("at") > 0, F.col("at"), F.size("titles")
    pages = F.transform(F.sequence(F.lit(0), n - 1), lambda i: obj(page(i), text("/Type /Page /Parent 2 0 R")))
    following = lambda j: F.when(j + 1 < F.size(at), F.concat(F.lit(" /Next "), mark(F.get(at, j + 1)).cast("string"), F.lit(" 0 R"))).otherwise("")
    marks = F.transform(at, lambda i, j: obj(mark(i), text("/Title (", F.element_at("titles", i + 1), ") /Parent 4 0 R /Dest [", page(i), " 0 R /Fit]", following(j))))
    kids = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(page(i).cast("string"), F.lit(" 0 R"))), " ")
    below = F.when(some, F.concat(F.lit(" /First "), mark(F.get(at, 0)).cast("string"), F.lit(" 0 R"))).otherwise("")
    fixed = [obj(F.lit(1), text("/Type /Catalog /Pages 2 0 R /Outlines 3 0 R")), obj(F.lit(2), text("/Type /Pages /Count ", n, " /Kids [", kids, "]")), obj(F.lit(3), text("/Type /Outlines /First 4 0 R")), obj(F.lit(4), text("/Title (", F.col("source"), ") /Parent 3 0 R /Dest [10 0 R /Fit]", below))]
    key = F.col("doc_id")
    tail = F.when(key % 13 == 5, "").otherwise(F.concat(F.lit("trailer\n<< /Root 1 0 R"), F.when(key % 11 == 0, " /Encrypt 9 0 R").otherwise(""), F.lit(" >>\nstartxref\n0\n%%EOF")))
    whole = F.concat(F.when(key % 17 == 3, "").otherwise("%PDF-1.4\n"), *fixed, F.array_join(pages, ""), F.array_join(marks, ""), tail)
    return rows.select(key.cast("string").alias("path"), whole.cast("binary").alias("content"))


@query(
    f"""with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_extract(lower(x), '{tx.LATIN_TOKEN}')) as t from documents),
s as (select *, case when doc_id % 17 = 3 then 'not_pdf' when doc_id % 13 = 5 then 'broken' when doc_id % 11 = 0 then 'encrypted' else 'ok' end as status from l)
select doc_id, status, case when status = 'ok' then len(t) else 0 end as page_count,
  case when status = 'ok' then array_to_string(list_filter(list_transform(t, lambda x, i: case when x <> '' then x || '@' || i end), lambda x: x is not null), ',') else '' end as bookmarks from s"""
)
def pdf_documents(spark, d):
    """Pages and bookmarks of PDF files made of all documents, read as objects and references."""
    from .sources import pdf

    got = pdf.summary(_pdf_files(table(spark, d, "documents").where("text is not null")))
    below = F.transform(F.filter("toc", lambda x: x["level"] == 2), lambda x: F.concat(x["title"], F.lit("@"), x["page"].cast("string")))
    return got.select(F.col("path").cast("long").alias("doc_id"), "status", F.col("page_count").cast("long").alias("page_count"), F.array_join(below, ",").alias("bookmarks"))


# --- catalogs in buckets ----------------------------------------------------------------------------------


@query("select sha256(text) as content_id, count(distinct text) as texts from documents group by 1")
def stream_dedupe_stored(spark, d):
    """A file stream deduplicated against a stored catalog of digests, without state; a second run adds nothing."""
    from .sources.buckets import catalog as buckets
    from .streaming import ingest

    path, out = f"{d}/documents.parquet", shared_path(spark, "stored")
    known = buckets(spark, f"{out}/known", "content_id string", "content_id", 16)
    for _ in range(2):
        rows = spark.readStream.schema("text string").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(path)
        ingest.once_per_content_stored(rows, F.sha2("text", 256), known, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema("text string, content_id string").parquet(f"{out}/rows").groupBy("content_id").agg(F.count("*").alias("texts"))


@query("select o_custkey, count(*) as orders, max(o_orderdate) as last, coalesce(min(case when o_orderkey % 2 = 1 then o_orderkey end), min(o_orderkey)) as first_order from orders group by 1")
def bucket_upserts(spark, d):
    """Upserts in two batches, each applied twice, into a catalog of which only the touched buckets are rewritten."""
    from .sources.buckets import catalog as buckets

    known = buckets(spark, shared_path(spark, "upserts"), "o_custkey long, orders long, last timestamp, first_order long", "o_custkey", 8)
    o = table(spark, d, "orders").withColumn("last", F.col("o_orderdate").cast("timestamp"))
    combine = {"orders": lambda was, now: was + now, "last": lambda was, now: F.greatest(was, now)}
    for batch in (0, 1):
        part = o.where(F.col("o_orderkey") % 2 == 1 - batch).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("last").alias("last"), F.min("o_orderkey").alias("first_order"))
        for _ in range(2):
            known.upsert(part, batch, combine)
    return known.rows().select("o_custkey", "orders", "last", "first_order")


@query(
    """with o as (select *, row_number() over (order by value, event_id) as k, count(*) over () as n from events),
g as (select event_type, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from events)
select coalesce(event_type, '(all)') as event_type, n, p50, p95 from (
  select null as event_type, max(n) as n, avg(case when k in ((n + 1) // 2, n // 2 + 1) then value end) as p50, max(case when k = (n * 95 + 99) // 100 then value end) as p95 from o
  union all select event_type, max(n), avg(case when k in ((n + 1) // 2, n // 2 + 1) then value end), max(case when k = (n * 95 + 99) // 100 then value end) from g group by event_type)"""
)
def exact_quantiles(spark, d):
    """Median and nearest-rank 95th percentile of each group, and of all rows as one, by histograms that narrow down."""
    from .operators.evaluation import latency

    e = table(spark, d, "events")
    both = e.select("event_type", "value").unionByName(e.select(F.lit("(all)").alias("event_type"), "value"))
    return latency(both, "value", ["event_type"], gathered=100).select("event_type", "n", "p50", "p95")
