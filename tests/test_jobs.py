"""The jobs over growing input, after failures, and by their command lines; and the bucket catalog below them."""

import json
import logging
import os
import subprocess
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evigrain.operators.shared import shared_path
from evigrain.sources import buckets
from jobs import library_sync, question_evidence, settings

NAMES = library_sync.ROWS.replace(" string", "").replace(" long", "").split(", ")


def docs(spark, rows):
    return spark.createDataFrame(rows, library_sync.DOCUMENTS)


def put(spark, rows, folder, name):
    """One more file for a source folder, as a landing would bring it."""
    docs(spark, rows).coalesce(1).write.parquet(f"{folder}/{name}")


def parts(k):
    return {
        0: [(1, "The licensed text", "en", "a"), (2, "another one", "en", "b"), (7, "The licensed text", "fr", "c"), (8, None, "en", "a")],
        1: [(3, "a third; password = x", "en", "b"), (0, "another one", "de", "z"), (4, "  \n ", "en", "a"), (None, "lost", "en", "a")],
        2: [(9, "another one", "en", "b")] * 3 + [(10, "The licensed text", "en", "a")],
    }[k]


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        if r[0] is not None and r[1] and r[1].strip():
            by[r[1]].append(r)
    return sorted((min(x)[0], min(x)[2], min(x)[3], len(t), len(x)) for t, x in by.items())


def state(df):
    return sorted((r.first_id, r.lang, r.source, r.n_chars, r.n_rows) for r in df.collect())


def files(path):
    """{bucket: files} of a catalog on this machine."""
    top = f"{path.removeprefix('file:')}/rows"
    return {b: frozenset(f for f in os.listdir(f"{top}/{b}") if f.endswith(".parquet")) for b in os.listdir(top) if b.startswith("bucket=")}


def test_growing_input(spark, caplog):
    at = shared_path(spark, "sync")
    paths = {"source": f"{at}/in", "target": f"{at}/out", "checkpoint": f"{at}/progress"}
    put(spark, parts(0), paths["source"], "one")
    with caplog.at_level(logging.INFO):
        assert state(library_sync.run(spark, **paths)) == expected(parts(0))
    assert "4 rows read, 1 rejected" in caplog.text
    before = files(f"{at}/out/catalog")
    caplog.clear()
    with caplog.at_level(logging.INFO):
        assert state(library_sync.run(spark, **paths)) == expected(parts(0))
    assert files(f"{at}/out/catalog") == before and "0 batches, 0 rows read" in caplog.text
    put(spark, parts(1), paths["source"], "two")
    got = library_sync.run(spark, **paths, config={"files_per_batch": 1})
    assert state(got) == expected(parts(0) + parts(1))
    touched = {f"bucket={r[0]}" for r in docs(spark, parts(1)).where("doc_id is not null and trim(text) <> '' and doc_id <> 4").select(F.pmod(F.xxhash64(F.sha2("text", 256)), F.lit(16))).distinct().collect()}
    after = files(f"{at}/out/catalog")
    assert {b for b in after if after[b] != before.get(b)} == touched and len(touched) < 16
    put(spark, parts(2), paths["source"], "three")
    again = library_sync.run(spark, **paths)
    assert state(again) == expected(parts(0) + parts(1) + parts(2))
    assert {r.tags for r in again.collect()} == {"licence", "", "secret"} and again.columns == NAMES
    bad = Counter(r.reason for r in spark.read.parquet(f"{at}/out/rejected").collect())
    assert bad == {"no id": 1, "no text": 2}
    # all at once gives the same catalog
    once = library_sync.run(spark, paths["source"], f"{at}/once", f"{at}/once-progress")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


def test_a_batch_again_and_a_killed_batch(spark, monkeypatch):
    at, config = shared_path(spark, "sync"), library_sync.DEFAULTS
    whole = docs(spark, parts(0) + parts(1))
    library_sync.apply(docs(spark, parts(2)), 0, at, config)
    for _ in range(3):
        library_sync.apply(whole, 1, at, config)
    known = library_sync.library(spark, at, config)
    assert state(known.rows()) == expected(parts(0) + parts(1) + parts(2))
    assert spark.read.parquet(f"{at}/rejected").count() == 3
    # half of the buckets are written, then the run dies; the batch comes again
    paths = {"source": f"{at}/in", "target": f"{at}/killed", "checkpoint": f"{at}/progress"}
    put(spark, parts(0) + parts(1), paths["source"], "one")
    put(spark, parts(2), paths["source"], "two")
    real = library_sync.apply

    def half(rows, batch, target, config):
        real(rows.where(F.pmod(F.xxhash64(F.sha2("text", 256)), F.lit(16)) < 8), batch, target, config)
        raise RuntimeError("killed")

    monkeypatch.setattr(library_sync, "apply", half)
    with pytest.raises(Exception, match="killed"):
        library_sync.run(spark, **paths)
    monkeypatch.setattr(library_sync, "apply", real)
    assert state(library_sync.run(spark, **paths)) == expected(parts(0) + parts(1) + parts(2))
    assert spark.read.parquet(f"{at}/killed/rejected").count() == 3


def test_bucket_catalog(spark):
    path = shared_path(spark, "buckets")
    c = buckets.catalog(spark, path, "k string, v long, note string", "k", 4)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long, note string")
    add = {"v": lambda a, b: a + b}
    assert c.rows().count() == 0 and c.upsert(rows(), 0, add) == []
    c.upsert(rows(("a", 1, "x"), ("b", 2, None)), 1, add)
    assert sorted(r.k for r in c.fresh(rows(("a", 1, ""), ("z", 1, "")), 1).collect()) == ["a", "z"]  # batch 1 has brought it itself
    assert [r.k for r in c.fresh(rows(("a", 1, ""), ("z", 1, "")), 2).collect()] == ["z"]
    c.upsert(rows(("a", 10, "y"), ("c", 5, "n")), 3, add)
    c.upsert(rows(("a", 10, "y"), ("c", 5, "n")), 3, add)
    c.upsert(rows(("a", 100, "late")), 2, add)  # an older batch changes nothing any more
    got = sorted((r.k, r.v, r.note, r.first_batch, r.last_batch) for r in buckets.catalog(spark, path, c.schema, "k", 4).rows().collect())
    assert got == [("a", 11, "x", 1, 3), ("b", 2, None, 1, 1), ("c", 5, "n", 3, 3)]
    for bad in (rows(("a", 1, "")).union(rows(("a", 2, ""))), rows((None, 1, ""))):
        with pytest.raises(ValueError, match="key"):
            c.upsert(bad, 9, add)
    with pytest.raises(ValueError, match="settings"):
        buckets.catalog(spark, path, c.schema, "k", 5)


def test_question_evidence(spark, sf_dir, caplog):
    at = shared_path(spark, "evidence")
    spark.createDataFrame([(1, "graphene sensor sensitivity of the device. More words follow here", "s1"), (2, "the other device", "s2"), (3, None, "s1"), (4, "", None)], "doc_id long, text string, source string").write.parquet(f"{at}/d")
    turns = [(0, 1, "assistant", "hello"), (0, 2, "user", "graphene sensor"), (0, 3, "user", "later"), (100, 0, "user", "device of the unknown kind there"), (200, 0, "user", "nothing matches"), (7, 0, "user", "graphene")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/q")
    with caplog.at_level(logging.INFO):
        got = [sorted(map(tuple, question_evidence.run(spark, f"{at}/d", f"{at}/q", f"{at}/out", {"excerpt": 45}).collect()), key=str) for _ in range(2)]
    assert got[0] == got[1] and "4 documents read" in caplog.text and "3 pieces of evidence for 2 questions" in caplog.text
    brief = [(r[0], r[2], r[3], r[5], r[6], r[8]) for r in got[0]]
    assert brief == [(0, 1, 1, 1.0, "strong", "s1"), (100, 1, 2, 0.333333, "weak", "s2"), (100, 2, 1, 0.5, "weak", "s1"), (200, None, None, None, "none", None)]
    assert got[0][0][7] == "graphene sensor sensitivity of the device.……"


def test_command_lines(spark, tmp_path):
    at = shared_path(spark, "cli")
    put(spark, parts(0), f"{at}/in", "one")
    config = tmp_path / "own.json"
    config.write_text(json.dumps({"buckets": 2}))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    command = [sys.executable, "-m", "jobs.library_sync", "--source", f"{at}/in", "--target", f"{at}/out", "--checkpoint", f"{at}/progress", "--config", str(config)]
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell", "PYSPARK_PYTHON": sys.executable}
    for _ in range(2):
        done = subprocess.run(command, cwd=root, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
    assert "0 batches" in done.stderr and set(files(f"{at}/out/catalog")) <= {"bucket=0", "bucket=1"}
    assert state(spark.read.schema(library_sync.ROWS).parquet(f"{at}/out/catalog/rows")) == expected(parts(0))
    shipped = settings.load(spark, f"{root}/jobs/library_sync.json", library_sync.DEFAULTS)
    assert shipped == library_sync.DEFAULTS and settings.load(spark, f"{root}/jobs/question_evidence.json", question_evidence.DEFAULTS) == question_evidence.DEFAULTS
    config.write_text(json.dumps({"bucket": 2}))
    with pytest.raises(ValueError, match="unknown"):
        settings.load(spark, str(config), library_sync.DEFAULTS)
