"""Research direction of papers: declared, else by keywords, else by a given model, else none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ontology import Directions


def classify(papers: DataFrame, taxonomy: Directions, text: Column, least: int = 2, model=None, least_confidence: float = 0.6) -> DataFrame:
    """papers (direction, title) with direction_id, source, confidence, matched_terms.

    A keyword counts 3 in the title, else 1 in the text. The best direction needs `least` and must be alone at the top.
    model: a Column function of (title, text) giving struct(direction_id, confidence), for rows still unclassified.
    """
    declared = F.element_at(F.create_map(*[F.lit(x) for pair in taxonomy.alias.items() for x in pair]), F.lower(F.trim("direction")))
    title, body = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    scored = []
    for d in taxonomy.directions:
        inside = lambda where, k: F.contains(where, F.lit(k.lower()))
        head = F.array_compact(F.array(*[F.when(inside(title, k), F.lit(k)) for k in d["keywords"]]))
        rest = F.array_compact(F.array(*[F.when(~inside(title, k) & inside(body, k), F.lit(k)) for k in d["keywords"]]))
        scored.append(F.struct((-(F.size(head) * 3 + F.size(rest))).alias("minus"), F.lit(d["direction_id"]).alias("id"), F.concat(head, rest).alias("terms")))
    rows = papers.withColumn("_d", declared).withColumn("_s", F.array_sort(F.array(*scored)))
    top, second = -F.col("_s")[0]["minus"], -F.coalesce(F.get("_s", F.lit(1))["minus"], F.lit(0))
    ruled = (top >= least) & (top > second)
    guess = model(F.col("title"), text) if model else F.lit(None).cast("struct<direction_id string, confidence double>")
    rows = rows.withColumn("_m", F.when(F.col("_d").isNull() & ~ruled, guess))
    sure = F.col("_m.direction_id").isin(*sorted(taxonomy.ids)) & (F.col("_m.confidence") >= least_confidence)
    pick = lambda a, b, c, d: F.when(F.col("_d").isNotNull(), a).when(ruled, b).when(F.coalesce(sure, F.lit(False)), c).otherwise(d)
    empty = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "direction_id": pick(F.col("_d"), F.col("_s")[0]["id"], F.col("_m.direction_id"), F.lit("unclassified")),
            "direction_source": pick(F.lit("metadata"), F.lit("keyword_rule"), F.lit("model_fallback"), F.lit("unclassified")),
            "direction_confidence": pick(F.lit(1.0), F.round(top / F.greatest(top + second, F.lit(1)), 4), F.round(F.col("_m.confidence"), 4), F.lit(0.0)),
            "matched_terms": pick(F.array("direction"), F.col("_s")[0]["terms"], empty, empty),
        }
    ).drop("_d", "_s", "_m")
