"""The jobs as queries over the whole tables: each runs twice into one new shared folder and gives what stands there then."""

from __future__ import annotations

from evigrain.operators.shared import shared_path

from . import library_sync, question_evidence

_TOKEN = "[a-z0-9]+(?:[._+/-][a-z0-9]+)*"


def job1_library_sync(spark, sf_dir: str):
    """All documents registered by the stream; the second run finds nothing new."""
    at = shared_path(spark, "job1")
    paths = {"source": f"{sf_dir}/documents.parquet", "target": f"{at}/library", "checkpoint": f"{at}/checkpoint"}
    library_sync.run(spark, **paths)
    return library_sync.run(spark, **paths)


def job2_question_evidence(spark, sf_dir: str):
    """The questions' evidence from all documents; the second run replaces the first one's index and output."""
    at = shared_path(spark, "job2")
    paths = {"documents": f"{sf_dir}/documents.parquet", "questions": f"{sf_dir}/conversations.parquet", "target": at}
    question_evidence.run(spark, **paths)
    return question_evidence.run(spark, **paths)


QUERIES = {"job1_library_sync": job1_library_sync, "job2_question_evidence": job2_question_evidence}

ORACLES = {
    "job1_library_sync": rf"""
with d as (
  select sha256(text) as content_id, doc_id, lang, source, length(text) as n_chars, len(regexp_extract_all(lower(text), '{_TOKEN}')) as n_terms,
    array_to_string(list_filter([case when contains(lower(text), 'license') or contains(lower(text), 'licensed') or contains(lower(text), 'rights reserved') then 'licence' end,
      case when contains(lower(text), 'token =') or contains(lower(text), 'password') then 'secret' end], lambda x: x is not null), ',') as tags
  from documents where doc_id is not null and regexp_matches(text, '\S')),
o as (select *, row_number() over (partition by content_id order by doc_id, lang nulls first, source nulls first) as k, count(*) over (partition by content_id) as n_rows from d)
select content_id, doc_id as first_id, lang, source, n_chars, n_terms, tags, n_rows from o where k = 1""",
    "job2_question_evidence": f"""
with t as (select conv_id, text, row_number() over (partition by conv_id order by turn, text) as k from conversations where conv_id % 100 = 0 and role = 'user' and text is not null),
q as (select conv_id, text, regexp_extract_all(lower(text), '{_TOKEN}') as terms from t where k = 1),
d as (select doc_id, text, source, regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}') as terms from documents where doc_id is not null),
s as (select count(*) as n, avg(len(terms)) as mean from d),
qt as (select conv_id, term, count(*) as times from (select conv_id, unnest(terms) as term from q) group by all),
p as (select doc_id, length, term, count(*) as tf from (select doc_id, len(terms) as length, unnest(terms) as term from d) where term in (select term from qt) group by all),
f as (select term, count(*) as df from p group by term),
c as (select conv_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) as score
      from p join f using (term) join qt using (term), s group by all),
r as (select *, row_number() over (partition by conv_id order by round(score, 9) desc, cast(doc_id as varchar)) as rank from c),
x as (select r.conv_id, rank, r.doc_id, round(score, 6) as score, round(len(list_intersect(list_distinct(q.terms), list_distinct(d.terms))) / len(list_distinct(q.terms)), 6) as coverage,
        d.source, trim(regexp_replace(d.text, '\\s+', ' ', 'g')) as t from r join q using (conv_id) join d using (doc_id) where rank <= 5),
h as (select *, substring(t, 1, 160) as head, max(coverage) over (partition by conv_id) as best from x),
z as (select *, greatest({", ".join(f"case when contains(head, '{m}') then 160 - position('{m}' in reverse(head)) + 1 else 0 end" for m in "。！？;.")}) as stop from h),
e as (select conv_id, rank, doc_id, score, coverage, case when best >= 0.6 then 'strong' when best >= 0.2 then 'weak' end as level, source,
        case when length(t) <= 160 then t else rtrim(case when stop - 1 >= 88 then substring(head, 1, stop) else head end) || '……' end as excerpt from z)
select q.conv_id, len(list_distinct(q.terms)) as question_terms, cast(rank as integer) as rank, doc_id, score, coverage, coalesce(level, 'none') as level, excerpt, source
from q left join (select * from e where level is not null) using (conv_id)""",
}
