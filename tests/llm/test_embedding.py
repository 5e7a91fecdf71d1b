import duckdb
import numpy as np

from evigrain.llm import embedding_dedup as e
from evigrain.llm.common import connected_components, read_table


def brute(rows, threshold=0.98):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    n, links, low = len(rows), [0] * len(rows), list(range(len(rows)))
    find = lambda x: x if low[x] == x else find(low[x])
    good = [r[2] is not None and ok(r[1]) for r in rows]
    v = [np.array(r[1], np.float64) if g else None for r, g in zip(rows, good)]
    for i in range(n):
        for j in range(i + 1, n):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]):
                if v[i] @ v[j] / (np.linalg.norm(v[i]) * np.linalg.norm(v[j])) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    low[find(j)] = find(i)
    smallest = {}
    for i in range(n):
        smallest[find(i)] = min(smallest.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], smallest[find(i)]) for i in range(n))


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, err = e.quantise(x)
    got = (q.astype(np.int64) @ q.T.astype(np.int64)) * s[:, None] * s[None, :]
    assert (np.abs(got - x @ x.T) <= err[:, None] + (1 + err[:, None]) * err[None, :] + e.SLACK).all()


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(150):
        v = (base[i % 12] * rng.uniform(0.1, 5) + rng.normal(size=8) * 0.08).astype(np.float32)
        rows.append((1000 - i, [float(x) for x in v], int(i % 2)))
    rows += [(2000 + k, rows[0][1], 0) for k in range(5)]
    rows += [(1, None, 1), (2, [0.0] * 8, 1), (3, [float("nan")] + [1.0] * 7, 1), (4, [None] + [1.0] * 7, 1), (5, rows[0][1], None), (6, [], 0), (7, rows[0][1][:4], 0), (8, [float("inf")] * 8, 0)]
    df = spark.createDataFrame([(a, v, c, 0) for a, v, c in rows], "vec_id long, embedding array<float>, label int, rep int")
    for block in (2048, 7):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in e.near_components(df, block=block).collect())
        assert got == brute(rows)
    con = duckdb.connect()
    con.sql("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", [list(r) for r in rows])
    assert sorted(con.sql(f"select vec_id, n_links, component_id from ({e.ORACLE_SQL})").fetchall()) == brute(rows)
    assert e.near_components(df.limit(0)).count() == 0


def test_parts_of_any_size(spark):
    rows = [(1, [1e200, 0.0], 0), (2, [1e200, 1e199], 0), (3, [3e-220, 0.0], 0), (4, [0.0, 1e-300], 0), (5, [1e308, 1e308], 1), (6, [-1e308, -1e308], 1), (7, [2e-308, 2e-308], 1), (8, [5e-324, 0.0], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in e.near_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (5, 1, 5), (6, 0, 6), (7, 1, 5), (8, 3, 1)]
    ints = spark.createDataFrame([(1, [3, 4], 0), (2, [6, 8], 0)], "vec_id long, embedding array<int>, label int")
    assert [r.n_links for r in e.near_components(ints).collect()] == [1, 1]


def test_embeddings_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in read_table(spark, sf_dir, "embeddings").collect()]
    got = e.op7_embedding_near_dedup(spark, sf_dir).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 150)] + [(7, 7), (900, 900), (500, 501), (501, 500), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in range(100, 150))
    assert got[900] == 900 and got[500] == got[501] == 500 and len(got) == 60 + 50 + 3
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
