"""The need-to-solution workflow as one plan over many needs, with a trace and fail-fast steps.

Embedding is an adapter: a function of a DataFrame and the names of its text column and of the vector column to add.
The default hashes tokens, needs no model and is the same everywhere.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.text import LATIN_TOKEN, tokens
from ..operators import matching, needs, solutions
from ..operators.retrieval import paper_evidence
from ..operators.shared import require_none

# Fixed value: what a Chinese retrieval model wants before a query.
QUERY_INSTRUCTION = "为这个句子生成表示以用于检索相关文章："
DIMENSIONS = 64


def _unit(words) -> list[float] | None:
    v = np.zeros(DIMENSIONS)
    for w in () if words is None else words:
        h = zlib.crc32(w.encode())
        v[h % DIMENSIONS] += 1.0 if h >> 20 & 1 else -1.0
    n = np.linalg.norm(v)
    return (v / n).tolist() if n else None


def hashed_vectors(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with a unit vector of signed token counts by hash; null without tokens. Terms are made by the JVM."""
    names = [c for c in rows.columns if c != out]
    schema = StructType([*[rows.schema[c] for c in names], StructField(out, ArrayType(DoubleType()))])
    terms = rows.select(*names, tokens(F.col(text)).alias("_terms"))

    def run(batches):
        for batch in batches:
            vectors = [_unit(w) for w in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(vectors, pa.list_(pa.float64()))], [*names, out])

    return terms.mapInArrow(run, schema)


#: Adds a vector column for a text column; may drop no row.
Embed = Callable[[DataFrame, str, str], DataFrame]


def with_vectors(rows: DataFrame, key: str, lists: dict[str, Column], embed: Embed) -> DataFrame:
    """(key, each list as array<struct(name, vector)>): all names of all lists are embedded in one pass, equal ones of a row once."""
    each = rows.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("list"), c.alias("names")) for k, c in lists.items()])).alias("x"))
    # rows without names stay as rows with a null name; nothing is joined with itself
    names = embed(each.select(key, "x.list", F.posexplode_outer("x.names").alias("at", "name")), "name", "vector")
    packed = names.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("list", "at", "name", "vector"))).alias("all"))
    own = lambda k: F.transform(F.filter("all", lambda x: (x["list"] == k) & x["name"].isNotNull()), lambda x: F.struct(x["name"].alias("name"), x["vector"].alias("vector")))
    return packed.select(key, *[own(k).alias(k) for k in lists])


def need_query() -> Column:
    """A need's text for retrieval: the request, then each known field."""
    known = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    many = lambda label, c: known(label, F.array_join(c, "；"))
    return F.concat_ws(
        "\n",
        F.nullif(F.col("original_request"), F.lit("")),
        known("行业：", F.col("industry")),
        known("产品：", F.col("product")),
        many("技术问题：", F.col("technical_problems")),
        many("所需科研能力：", F.col("required_capabilities")),
        many("约束：", F.col("constraints")),
        many("关键词：", F.col("keywords")),
    )


@dataclass
class State:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    trace: list[dict] = field(default_factory=list)


def checked(embed: Embed, longest: int | None = None, instruction: str = "") -> Embed:
    """An embedder that refuses empty texts and those of more than `longest` Latin words and Chinese characters, and puts an instruction before each.

    Queries take QUERY_INSTRUCTION, documents none. Null texts stay without a vector.
    """

    def run_(rows: DataFrame, text: str, out: str) -> DataFrame:
        t = F.col(text)
        bad = F.when(F.trim(t) == "", "a text to embed is empty")
        if longest is not None:
            terms = F.regexp_count(F.lower(t), F.lit(LATIN_TOKEN)) + F.regexp_count(t, F.lit("[㐀-鿿]"))
            bad = bad.when(terms > longest, F.concat(F.lit(f"a text to embed has more than {longest} terms: "), F.substring(t, 1, 40)))
        asked = F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.concat(F.lit(instruction), t))
        own = [c for c in rows.columns if c != out]
        return embed(rows.withColumn("_asked", asked), "_asked", out).select(*own, out)

    return run_


def run(requests: DataFrame, profiles: DataFrame, chunks: DataFrame, embed: Embed = hashed_vectors, k: int = 5, sources: DataFrame | None = None) -> State:
    """requests: need_id, request_text, confirmed; profiles: operators.profiles.profiles(); chunks: chunk_id, text, teacher, embedding, page_start, page_end.

    The tables of the state are lazy and kept once computed (unpersist() frees them); a step that fails ends the run,
    and the trace says which.
    """
    state = State()
    t = state.tables
    if sources is None:  # what profiles hold was said with sources, or operators.profiles had refused it
        sources = profiles.select("teacher", F.explode(matching.ordered_distinct(F.concat("core_capabilities", "research_directions"))).alias("item"), F.lit(1).alias("sources"))

    def requirement():
        t["profiles"] = needs.parse(requests)
        require_none(t["profiles"].where("error is not null").select("need_id", "error"), "a request can't be read")

    def clarification():
        t["questions"] = solutions.clarification(t["profiles"])

    def research():
        domain = F.array_join(F.filter(F.array("industry", "product"), lambda v: v != needs.UNKNOWN), "；")
        wanted = {"whole": F.array(need_query()), "domain": F.array(F.nullif(domain, F.lit(""))), "capabilities": matching.ordered_distinct(F.col("required_capabilities"))}
        only = lambda c: F.get(c, F.lit(0))["vector"]
        found = with_vectors(t["profiles"], "need_id", wanted, embed)
        t["needs"] = found.select("need_id", only("whole").alias("vector"), only("domain").alias("domain_vector"), "capabilities")
        both = lambda *cs: matching.ordered_distinct(F.concat(*cs))
        items = both("research_directions", "core_capabilities", "application_domains", "potential_industries")
        t["people"] = with_vectors(profiles, "teacher", {"items": items, "technologies": both("core_capabilities", "research_directions"), "applications": both("application_domains", "potential_industries")}, embed)

    def paper():
        t["evidence"] = paper_evidence(chunks, t["needs"].select(F.col("need_id").alias("query_id"), F.col("vector").alias("embedding")), "teacher", k, matching.PAPER_THRESHOLD).withColumnRenamed("query_id", "need_id")

    def match():
        t["matches"] = matching.match(t["needs"], t["people"], t["evidence"], k)

    def solution():
        t["modules"] = solutions.modules(t["profiles"])
        asked = embed(t["modules"].select(F.concat_ws("|", "need_id", "module_id").alias("query_id"), F.concat_ws("\n", "name", "problem", "product").alias("q")), "q", "embedding")
        found = paper_evidence(chunks, asked, "teacher", k, matching.PAPER_THRESHOLD)
        split = F.split("query_id", r"\|")
        found = found.select(split[0].alias("need_id"), split[1].alias("module_id"), "teacher", "chunk_id", "similarity")
        t["support"] = solutions.support(t["modules"], found, matching.recommended(t["matches"]).select("need_id", "teacher"))
        t["gate"] = solutions.gate(t["profiles"], t["support"])
        t["nodes"], t["edges"] = solutions.route(t["support"], t["gate"])

    def review():
        t["transfer"] = solutions.transfer(t["profiles"], t["support"], t["questions"])
        chosen = matching.recommended(t["matches"]).select("need_id", "teacher")
        technologies = matching.capability_matches(t["needs"], t["people"]).where("matched").select("need_id", "teacher", "item")
        t["review"] = solutions.review(chosen, t["evidence"].withColumn("evidence_teacher", F.col("teacher")), technologies, sources)
        require_none(solutions.invalid_bundles(t["profiles"], t["support"], t["edges"], t["nodes"]), "a solution can't be traced")

    def report():
        t["landing_plan"] = solutions.landing_plan(t["nodes"], t["transfer"])

    for step in (requirement, clarification, research, paper, match, solution, review, report):
        began = time.time()
        entry = {"step": step.__name__, "status": "completed"}
        state.trace.append(entry)
        try:
            before = set(t)
            step()
            for name in set(t) - before:  # later steps read it several times
                t[name] = t[name].persist()
        except Exception as e:
            entry |= {"status": "failed", "error": str(e)[:500]}
            raise
        finally:
            entry["seconds"] = round(time.time() - began, 3)
    return state
