"""Embedding near-duplicates by int8 tiles with rigorous error bounds.

Vectors of a label and dimension are dealt into blocks; each pair of blocks is a tile. In a tile the unit vectors are
quantised to int8 with a scale each, x = s q + r, and the length e of the rest r is kept. Then
|x.y - s_x s_y q_x.q_y| <= e_x + (1 + e_x) e_y, so only pairs whose int8 product comes that close to the threshold are
computed again in double precision. int8 products are summed exactly. Equal vectors are one vector with a multiplicity,
so a vector that a third of all rows share costs no more than any other. Tiles return link counts and a spanning forest
of their links, not the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key, connected_components, materialize, read_table

THRESHOLD = 0.98
#: Vectors of a block: a tile holds two blocks.
BLOCK = 2048
#: Absolute allowance for rounding in the bounds themselves.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, s, e) of unit vectors: x = s q + r with q of -127 to 127 and |r| <= e."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(unit - scale[:, None] * q, axis=1) + 1e-12


def level(v: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest part to 0.5 to 1: squares of the largest parts can
    neither overflow nor vanish, and cosines stay what they are, as no digit changes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool):
    """For each row of a, the rows of b (behind it, if same) with a cosine of threshold or more: (i, js) where any.

    Rows are finite, not zero and of level(); a cosine of exactly the threshold links; equal rows link.
    """
    ua, ub = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    (qa, sa, ea), (qb, sb, eb) = quantise(ua), quantise(ub)
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64  # products of int8 are exact in it
    qb_t = np.ascontiguousarray(qb.astype(kind).T)
    for k in range(0, len(a), 64):
        near = (qa[k : k + 64].astype(kind) @ qb_t) * (sa[k : k + 64, None] * sb[None, :])
        near += ea[k : k + 64, None] + (1 + ea[k : k + 64, None]) * eb[None, :] + SLACK
        maybe = near >= threshold
        if same:
            maybe &= np.arange(len(b))[None, :] > np.arange(k, k + len(maybe))[:, None]
        for i in np.flatnonzero(maybe.any(axis=1)):
            js = np.flatnonzero(maybe[i])
            x, y = a[k + i], b[js]
            cosine = (y @ x) / (np.sqrt(x @ x) * np.sqrt((y * y).sum(axis=1)))
            js = js[cosine >= threshold]
            if len(js):
                yield k + int(i), js


def near_components(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: links to other vectors of its label and dimension, its component, and whether it is kept.

    Without a label or a usable vector (null, empty, zero, null or non-finite parts): no links, a component of its own.
    Ties: cosine = threshold is a link. Repeated rows are vectors of their own and link with each other. Finite parts
    of any size are compared, as vectors are scaled first. An empty table gives an empty result.
    """
    # floats stay floats until a tile needs them: half the bytes to shuffle, and no digit lost
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    v = F.col(vector) if kind in ("float", "double") else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("usable", F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    good = rows.where("usable").select("vec_id", F.struct("label", "v").alias("k"))
    classes = materialize(good.groupBy("k").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    group = [F.col("k.label").alias("label"), F.size("k.v").alias("dim")]
    sizes = classes.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = classes.select("rep", "n", "k.v", *group).join(sizes, ["label", "dim"]).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "dim", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "rep", "n", "v"
    )
    schema = "rep long, links long, root long"

    def join_tile(table: pa.Table) -> pa.Table:
        first, second = table["i"][0].as_py(), table["j"][0].as_py()
        at, rep, n = (table[c].to_numpy() for c in ("b", "rep", "n"))
        order = np.lexsort((rep, at))
        flat = table["v"].combine_chunks()
        v = level(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)[order])
        at, rep, n = at[order], rep[order], n[order]
        cut = int((at == first).sum())
        same = first == second
        a, b = (v, v) if same else (v[:cut], v[cut:])
        shift = 0 if same else cut
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for i, js in tile_links(a, b, threshold, same) if len(a) and len(b) else ():
            js = js + shift
            links[i] += n[js].sum()
            links[js] += n[i]
            merged = np.unique(root[np.append(js, i)])
            if len(merged) > 1:
                root[np.isin(root, merged)] = merged[0]
        hit = np.flatnonzero(links)
        low = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(low, root, rep)
        return pa.table({"rep": rep[hit], "links": links[hit], "root": low[root[hit]]})

    found = materialize(tiles.groupBy("label", "dim", "i", "j").applyInArrow(join_tile, schema), "links")
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vectors")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    result = (
        classes.join(linked, "rep", "left")
        .join(components.withColumnRenamed("id", "rep"), "rep", "left")
        .select("k", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    result = materialize(result, "vector-classes")
    done = attach_by_key(good, result, "k", "n").select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All rows of embeddings by cosine within their labels; see near_components() for unusable vectors."""
    return near_components(read_table(spark, sf_dir, "embeddings"))


#: Every pair of a label is compared, so this is for small tables; ids are unlike and not null.
ORACLE_SQL = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
  SELECT a.id AS a, b.id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.id <> b.id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS id, vec_id AS other FROM embeddings
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other
), low AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN low ON low.id = vec_id LEFT JOIN counts ON counts.id = vec_id
"""
