"""Bounded batches of work on catalog papers: candidates become busy, then done or failed, and no failure ends a batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import catalog

# The states of the two kinds of work, and how much of an error is kept.
PARSING = {"first": "metadata_pending", "busy": "parsing", "done": "parsed", "failed": "failed"}
INDEXING = {"first": "parsed", "busy": "indexing", "done": "indexed", "failed": "index_failed"}
ERROR_LENGTH, MESSAGES = 1000, 50


def attempt(rows: DataFrame, work: Callable[[dict], object], result: str, key: str = "paper_id") -> DataFrame:
    """(key, result, error): work on each row as a dictionary, on the executors; what it raises becomes the row's error."""

    def run(frames):
        for frame in frames:
            out = []
            for record in frame.to_dict("records"):
                try:
                    out.append((record[key], work(record), None))
                except Exception as e:  # noqa: BLE001 - any failure is this row's only
                    out.append((record[key], None, (str(e).strip() or type(e).__name__)[:ERROR_LENGTH]))
            yield pd.DataFrame(out, columns=[key, "result", "error"])

    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, result {result}, error string")


@dataclass
class Batch:
    requested: int
    completed: int
    failed: int
    paper_ids: list
    errors: list[str] = field(default_factory=list)
    results: DataFrame | None = None
    papers: DataFrame | None = None


def run_batch(papers: DataFrame, work: Callable[[DataFrame], DataFrame], states: dict[str, str], now: Column, save: Callable[[DataFrame], None] | None = None, limit: int = 10, teacher: str = "", retry_failed: bool = False) -> Batch:
    """Work on at most `limit` (1 to 100) papers; the batch says what became of each, `papers` has the new states.

    work: papers to (paper_id, result, error), such as attempt(); it runs once, and its rows are kept. save gets the papers
    as they are while the work is under way, so that recover() finds them if the driver is lost. Up to MESSAGES errors
    are listed with their titles.
    """
    chosen = catalog.candidates(papers, states["first"], limit, retry_failed, teacher, states["failed"])
    rows = chosen.collect()  # limit rows at most
    spark = papers.sparkSession
    chosen = spark.createDataFrame(rows, papers.schema)
    change = lambda ids, status, error: ids.select("paper_id", status.alias("status"), error.alias("error_message"), now.alias("at"))
    if save is not None:
        save(catalog.set_status(papers, change(chosen, F.lit(states["busy"]), F.lit(""))))
    done = work(chosen).select("paper_id", "result", "error").persist()
    ended = {r["paper_id"]: r["error"] for r in done.select("paper_id", "error").collect()}
    missing = [r for r in rows if r["paper_id"] not in ended]
    if missing:
        raise ValueError(f"the work lost {len(missing)} papers")
    bad = [r for r in rows if ended[r["paper_id"]] is not None]
    after = catalog.set_status(papers, change(done, F.when(F.col("error").isNull(), states["done"]).otherwise(states["failed"]), F.coalesce("error", F.lit(""))))
    return Batch(len(rows), len(rows) - len(bad), len(bad), [r["paper_id"] for r in rows if ended[r["paper_id"]] is None], [f"{r['title']}: {ended[r['paper_id']]}" for r in bad[:MESSAGES]], done.where("error is null").drop("error"), after)
