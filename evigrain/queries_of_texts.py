"""Queries that hold the engine's rules against a second statement of them over all documents, turns, pages and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_of_queries import DENSE_SQL
from .functions import text as tx
from .functions import vectors as vx
from .operators import catalog, evidence, layout, matching, retrieval
from .operators.shared import shared_path, small
from .plans import answers, experiment
from .registry import query, table
from .sources import files

_SQUEEZED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query(
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
c as (select doc_id, n, {_SQUEEZED.format("case n % 3 when 0 then n || ' ' || line when 1 then (n % 7) || '.' || (n % 5) || case when n % 2 = 0 then '.1' else '' end || ' ' || line else line end")} as t from l),
h as (select *, length(t) <= 100 and ({" or ".join(f"regexp_matches(t, '{p}')" for p in layout.HEADINGS)}) as heading, len(regexp_extract_all(regexp_extract(t, '^(\\d+(?:\\.\\d+){{0,3}})\\s+', 1), '\\.')) + 1 as level from c)
select doc_id, count(*) as lines, count_if(heading) as headings, max(case when heading then level end) as deepest, cast(sum(case when heading then n * level else 0 end) as bigint) as checksum from h group by doc_id"""
)
def line_headings(spark, d):
    """Which lines of all documents look like headings when they are numbered, and of which level."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)
    n = F.col("n")
    numbered = F.when(n % 3 == 0, F.concat(n, F.lit(" "), "line")).when(n % 3 == 1, F.concat(n % 7, F.lit("."), n % 5, F.when(n % 2 == 0, ".1").otherwise(""), F.lit(" "), "line")).otherwise(F.col("line"))
    level = layout.heading_level(numbered)
    each = rows.select("doc_id", "n", layout.is_heading(numbered).alias("h"), level.alias("level"))
    return each.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("h").alias("headings"), F.max(F.when(F.col("h"), F.col("level"))).cast("long").alias("deepest"), F.sum(F.when(F.col("h"), n * F.col("level")).otherwise(0)).cast("long").alias("checksum"))


@query("with r as (select page_id, case when url like 'https://%' then substring(url, 9) else url end as rest from pages) select page_id, case when contains(rest, '/') then split_part(rest, '/', 1) else '' end as owner from r")
def url_owners(spark, d):
    """The first folder of each page's address below a root."""
    return table(spark, d, "pages").select("page_id", files.owner_of(F.replace(F.col("url"), F.lit("https://"), F.lit("#library/")), "#library").alias("owner"))


@query(
    rf"""with t as (select doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{tx.LATIN_TOKEN}') as terms from documents)
select doc_id, len(terms) as terms, len(list_distinct(terms)) as unlike, coalesce(list_aggregate(terms, 'max'), '') as last from t"""
)
def folded_terms(spark, d):
    """The terms of all documents, folded: their number, how many are unlike, the last in order."""
    t = table(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("terms"), F.size(F.array_distinct("t")).cast("long").alias("unlike"), F.coalesce(F.array_max("t"), F.lit("")).alias("last"))


@query(f"select conv_id, turn, regexp_matches(trim('团队' || substring(text, 1, cast(turn * 3 + length(text) % 5 as integer)) || '主要研究'), '{answers.OVERVIEW}') as overview from conversations")
def overview_turns(spark, d):
    """Questions for an overview, by what stands between the two words: up to twelve characters, no line end."""
    between = F.substring(F.col("text"), F.lit(1), (F.col("turn") * 3 + F.length("text") % 5).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", answers.is_overview(F.concat(F.lit("团队"), between, F.lit("主要研究"))).alias("overview"))


@query(
    rf"""with t as (select doc_id, trim(replace(substring(text, 1, cast(60 + doc_id % 400 as integer)), ',', ' = ') || case when doc_id % 2 = 0 then ' (' || (doc_id % 9) || '.' || (doc_id % 4) || ')' else '' end) as t from documents),
s as (select doc_id, t, len(regexp_extract_all(t, '=')) as e, len(regexp_extract_all(t, chr(10))) >= 2 as lines, regexp_matches(t, '{evidence.EQUATION_NUMBER}') as numbered, regexp_matches(t, '[{chr(0xF000)}-{chr(0xF8FF)}]') as glyph from t)
select doc_id, cast(case when e > 0 and length(t) <= 420 and (numbered or lines or glyph) then 8 * numbered::int + 4 * lines::int + 2 * glyph::int + least(3, e) else 0 end as integer) as score from s"""
)
def formula_texts(spark, d):
    """How much the beginnings of all documents look like formulas, their commas read as equals signs."""
    key = F.col("doc_id")
    text = F.concat(F.replace(F.substring(F.col("text"), F.lit(1), (key % 400 + 60).cast("int")), F.lit(","), F.lit(" = ")), F.when(key % 2 == 0, F.concat(F.lit(" ("), key % 9, F.lit("."), key % 4, F.lit(")"))).otherwise(""))
    return table(spark, d, "documents").select("doc_id", evidence.formula_score(text).cast("int").alias("score"))


@query(
    """with c as (select min(doc_id) as first from documents)
select source as paper_id, lang as value, case when source = (select source from documents where doc_id = (select first from c)) and lang = (select lang from documents where doc_id = (select first from c)) then 'confirmed' else 'suggested' end as review_status,
  case when source = (select source from documents where doc_id = (select first from c)) and lang = (select lang from documents where doc_id = (select first from c)) then '2' else '1' end as updated_at from (select distinct source, lang from documents)"""
)
def reviewed_tags(spark, d):
    """Tags of sources by language, of which the first document's is confirmed."""
    docs = table(spark, d, "documents")
    pair = lambda rows: catalog.with_tag_ids(rows.select(F.col("source").alias("paper_id"), F.lit("custom").alias("category"), F.col("lang").alias("value"), F.lit("content_rule").alias("source"), F.lit("suggested").alias("review_status"), F.lit("1").alias("updated_at")))
    first = pair(docs.orderBy("doc_id").limit(1)).first()["tag_id"]
    return catalog.review_tag(pair(docs.select("source", "lang").distinct()), first, "confirmed", "2").select("paper_id", "value", "review_status", "updated_at")


@query("select vec_id, round(case when label % 2 = 0 then -2 * embedding[1]::double else embedding[1]::double end, 6) as first, len(embedding) as width from embeddings where embedding is not null")
def vector_upserts(spark, d):
    """Vectors of even labels come again, turned round and longer."""
    old = table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    new = old.where("label % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * -2))
    got = catalog.upsert_vectors(old, new)
    return got.select(F.col("chunk_id").alias("vec_id"), F.round(F.col("embedding")[0], 6).alias("first"), F.size("embedding").cast("long").alias("width"))


@query("select a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 6) as score from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def neighbour_cosines(spark, d):
    """The cosine of each vector and the next one, which must be usable."""
    v = table(spark, d, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(vx.strict_cosine(F.col("embedding"), F.col("next")), 6).alias("score"))


@query(
    """with s as (select source, max(lang) as teacher, count(*)::integer as year from documents where doc_id % 2 = 0 group by source)
select doc_id, d.source as file_name, s.teacher, s.year from documents d left join s on s.source = d.source"""
)
def chunk_metadata(spark, d):
    """Documents with their source's catalog row; of sources without one the fields stay null."""
    docs = table(spark, d, "documents")
    papers = docs.where("doc_id % 2 = 0").groupBy(F.col("source").alias("file_name")).agg(F.max("lang").alias("teacher"), F.count("*").cast("int").alias("year"))
    return catalog.with_metadata(docs.select("doc_id", F.col("source").alias("file_name")), papers).select("doc_id", "file_name", "teacher", "year")


@query(
    "with p as (select l_orderkey, l_linenumber, l_discount * 10 as a, l_tax * 12 as b, l_quantity / 50 as c, 0.5::double as e from lineitem), x as (select *, unnest(['semantic_similarity', 'technical_capability_coverage', 'application_domain_match', 'paper_evidence_count']) as part, unnest([least(1, a), least(1, b), least(1, c), e]) as raw, unnest([0.45, 0.25, 0.15, 0.15])::double as weight from p) select l_orderkey, l_linenumber, part, round(raw, 4) as raw, weight, round(raw * weight * 100, 2) as contribution from x"
)
def score_breakdowns(spark, d):
    """The parts of a match's score over all lines' numbers."""
    li = table(spark, d, "lineitem")
    rows = li.select(F.struct("l_orderkey", "l_linenumber").alias("need_id"), F.lit("t").alias("teacher"), F.lit(0.0).alias("score"), (F.col("l_discount") * 10).alias("semantic_similarity"), (F.col("l_tax") * 12).alias("technical_capability_coverage"), (F.col("l_quantity") / 50).alias("application_domain_match"), F.lit(0.5).alias("paper_evidence_count"))
    return matching.breakdown(rows).select("need_id.l_orderkey", "need_id.l_linenumber", "part", "raw", "weight", "contribution")


_CHUNKS_SQL = """with v as (select vec_id as chunk_id, embedding::double[] as e, text from embeddings join documents on doc_id = vec_id),
q as (select chunk_id as query_id, e as q, text from v where chunk_id % 100 = 0),
x as (select query_id, chunk_id, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) as score from v, q),
de as (select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, cast(chunk_id as varchar)) as rank from x),
d as (select chunk_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+(?:[._+/-][a-z0-9]+)*') as terms from v),
s as (select count(*) as n, avg(len(terms)) as mean from d),
qt as (select chunk_id as query_id, term, count(*) as times from (select chunk_id, unnest(terms) as term from d where chunk_id % 100 = 0) group by all),
p as (select chunk_id, length, term, count(*) as tf from (select chunk_id, len(terms) as length, unnest(terms) as term from d) where term in (select term from qt) group by all),
f as (select term, count(*) as df from p group by term),
c as (select query_id, chunk_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) as score from p join f using (term) join qt using (term), s group by all),
bm as (select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, cast(chunk_id as varchar)) as rank from c),
u as (select query_id, chunk_id, 1.0::double / (60 + rank) as w from bm where rank <= 30 union all select query_id, chunk_id, 1.0::double / (60 + rank) from de where rank <= 30),
g as (select query_id, chunk_id, sum(w) as score from u group by all)"""


def _chunks(spark, d):
    """(chunk_id, text, embedding): the documents that have a vector; and as queries those with an id divisible by 100."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    # texts without a vector stay out of the join's shuffle
    texts = table(spark, d, "documents").select("doc_id", "text").join(small(v.select("doc_id")), "doc_id", "left_semi")
    rows = texts.join(v, "doc_id").withColumnRenamed("doc_id", "chunk_id")
    return rows, rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query"), "embedding")


@query(
    _CHUNKS_SQL
    + """ select query_id, chunk_id, round(score, 9) as score, cast(rank as integer) as rank from (
  select *, row_number() over (partition by query_id order by round(score, 12) desc, cast(chunk_id as varchar)) as rank from g) where rank <= 10"""
)
def hybrid_dispatch(spark, d):
    """Hybrid search by its name, over documents that have a vector (top-k report)."""
    rows, q = _chunks(spark, d)
    return retrieval.hybrid_search(rows, q, "rrf", 10, 30).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query(DENSE_SQL + " select query_id, 'dense' as method, string_agg(chunk_id, ',' order by rank) as chunk_ids from de where rank <= 10 group by query_id")
def experiment_runs(spark, d):
    """A retrieval experiment's run file, as it was written (top-k report)."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit("").alias("text"))
    q = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").cast("string").alias("query_id"), F.lit("q").alias("query"), "embedding")
    out = shared_path(spark, "experiment")
    experiment.run_experiment(v, q, ["dense"], out, k=10)
    runs = spark.read.schema("query_id string, method string, chunk_ids array<string>").json(f"{out}/dense")
    return runs.select(F.col("query_id").cast("long").alias("query_id"), "method", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query(
    DENSE_SQL
    + """, fi as (select distinct 'f' || label as f from v order by f limit 5),
near as (select query_id, chunk_id, f, least(1, greatest(0, score)) as score from c join fi on f = 'f' || label where query_id % 200 = 0),
own as (select * from (select *, row_number() over (partition by query_id, f order by round(score, 9) desc, cast(chunk_id as varchar)) as n from near) where n = 1),
al as (select query_id, chunk_id, score, 0 as a, f as b, 0 as k from own union all select query_id, chunk_id, score, 1, '', rank from de where rank <= 5 and query_id % 200 = 0),
un as (select * from (select *, row_number() over (partition by query_id, chunk_id order by a, b, k) as n from al) where n = 1),
me as (select * from (select * exclude (n), row_number() over (partition by query_id order by a, b, k) as n from un) where n <= 5)
select query_id as question_id, chunk_id, round(score, 6) as score, cast(row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as integer) as rank from me
union all select query_id, chunk_id, round(score, 6), cast(rank as integer) from de where rank <= 5 and query_id % 200 <> 0"""
)
def retrieved_answers(spark, d):
    """Chunks for questions: plain ones get the nearest, overviews the best of each of the first papers (top-k report)."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.concat(F.lit("f"), "label").alias("file_name"))
    q = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("question_id"), (F.col("chunk_id") % 200 == 0).alias("overview"), "embedding")
    return answers.retrieve(v, q, 5).select("question_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(
    """select p_partkey, sha256('d' || p_partkey) as paper_id, case when p_partkey % 3 = 0 and trim(p_name) <> '' then trim(p_name) else 'f' || p_partkey end as title, case when p_partkey % 3 = 0 then p_brand else '' end as teacher,
  case when p_partkey % 3 = 0 and p_size % 2 = 0 then p_type else 'unclassified' end as direction, nullif(p_size % 7, 0)::integer as page_count, case when p_partkey % 2 = 0 then 'v2' else 'legacy' end as parser_version from part"""
)
def parsed_catalog(spark, d):
    """Catalog rows of parsed papers: a seed's metadata where it has some, defaults elsewhere."""
    part = table(spark, d, "part")
    name = F.concat(F.lit("f"), "p_partkey", F.lit(".pdf")).alias("file_name")
    parsed = part.select(name, (F.col("p_size") % 7).alias("total_pages"), F.when(F.col("p_partkey") % 2 == 0, "v2").otherwise(" ").alias("parser_version"))
    text = lambda c: F.lit(None).cast(c)
    seed = part.where("p_partkey % 3 = 0").select(name, F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("title"), text("array<string>").alias("authors"), F.col("p_brand").alias("teacher"), text("int").alias("year"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("direction"), text("string").alias("authorization_note"))
    digests = part.select(name, F.sha2(F.concat(F.lit("d"), "p_partkey"), 256).alias("paper_id"), F.lit("p").alias("file_path"))
    got = catalog.parsed_as_papers(parsed, seed, digests, F.lit("1"))
    return got.select(F.regexp_extract("file_name", r"\d+", 0).cast("long").alias("p_partkey"), "paper_id", "title", "teacher", "direction", "page_count", "parser_version")
