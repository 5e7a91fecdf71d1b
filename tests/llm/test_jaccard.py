import re

import duckdb
import numpy as np
import pyarrow as pa

from evigrain.llm import jaccard_join as j
from evigrain.llm.common import read_table


def brute(rows, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    low = list(range(len(rows)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    index = {}
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    pairs = {(a, b) for own in index.values() if len(own) < 2000 for k, a in enumerate(own) for b in own[k + 1 :]}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            low[max(find(a), find(b))] = min(find(a), find(b))
    smallest = {}
    for i, (d, _) in enumerate(rows):
        smallest[find(i)] = min(d, smallest.get(find(i), d))
    return sorted((d, len(sets[i]), smallest[find(i)]) for i, (d, _) in enumerate(rows))


def texts(seed=0, n=120):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    shared = " ".join(rng.choice(words, 60))
    base = [list(rng.choice(words, int(rng.integers(20, 160)))) for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(base[i % 8])
        for _ in range(int(rng.integers(0, 8))):
            w[int(rng.integers(0, len(w)))] = str(rng.choice(words))
        if i % 5 == 0:
            w = [shared, *w]
        rows.append((10_000 - 3 * i, " ".join(w)))
    return rows


def test_region_join_is_exact():
    rng = np.random.default_rng(5)
    for trial in range(12):
        centre = rng.integers(0, 1 << 40, (3, 120), dtype=np.uint64)
        sets = []
        for i in range(150):
            s = centre[i % 3].copy()
            k = int(rng.integers(0, 30))
            s[rng.choice(120, k, replace=False)] = rng.integers(0, 1 << 40, k, dtype=np.uint64)
            sets.append(np.unique(s))
        ids = rng.permutation(1000)[:150].astype(np.int64)
        got = j.join_region(ids, sets)
        parent = list(range(150))
        find = lambda x: x if parent[x] == x else find(parent[x])
        for a in range(150):
            for b in range(a):
                n = len(np.intersect1d(sets[a], sets[b]))
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    parent[find(a)] = find(b)
        for a in range(150):
            assert got[a] == min(ids[b] for b in range(150) if find(b) == find(a))


def test_against_brute_force(spark):
    rows = texts() + [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "é É five six seven"), (8, "w " * 30_000), (9, "w " * 9)]
    rows += [(20_000 + k, rows[3][1].upper()) for k in range(30)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, component_id int")
    want = brute(rows)
    for region in (j.REGION, 900):
        got = sorted(tuple(r) for r in j.near_components(df, region=region).collect())
        assert got == want
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [list(r) for r in rows])
    assert sorted(con.sql(f"select doc_id, n_shingles, component_id from ({j.ORACLE_SQL})").fetchall()) == want
    assert j.near_components(df.limit(0)).count() == 0


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in j.op9_jaccard_join(spark, sf_dir).collect()) == brute(rows)


def sharing(n=160):
    """Documents of their own words with a passage of the one before, so chains hold all of them, and some near copies."""
    rng = np.random.default_rng(3)
    word = iter(range(10**6))
    passages = [[f"p{next(word)}" for _ in range(30)] for _ in range(n + 1)]
    rows = []
    for i in range(n):
        own = [[f"w{next(word)}" for _ in range(70)] for _ in range(2)]
        rows.append((5000 - i, " ".join([*own[0], *passages[i], *own[1], *passages[i + 1]])))
    for i in range(0, n, 8):
        w = rows[i][1].split()
        w[int(rng.integers(0, 200))] = "other"
        rows += [(7000 + i, " ".join(w)), (8000 + i, rows[i][1])]
    return rows


def test_chains_of_shared_passages_are_divided(spark, monkeypatch):
    """In an order that hardly knows what is rare, chains of meetings are no region that is dealt into blocks."""
    rows = sharing()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept, was = [], j.materialize

    def seen(df, tag, *more):
        out = was(df, tag, *more)
        if tag == "placed":
            kept.append(out.agg({"blocks": "sum"}).first()[0] - out.count())
        return out

    monkeypatch.setattr(j, "materialize", seen)
    monkeypatch.setattr(j, "BUCKET_BITS", 10)
    monkeypatch.setattr(j, "WIDTH", 1)
    assert sorted(tuple(r) for r in j.near_components(df, region=3000).collect()) == brute(rows)
    assert len(kept) > 1 and kept[0] > 0 and kept[-1] < kept[0] / 3


def test_meetings_need_room_for_the_shared_part(spark):
    """Sets of 100 shingles within the radius share 86, so two that first meet behind the 15th place don't meet at all."""
    rank = np.zeros(1 << j.BUCKET_BITS, np.uint8)
    of = lambda text: next(iter(j.shingle_sets(pa.array([text]), 5)))
    passage = min((f"s{k} t u v w" for k in range(100)), key=lambda p: abs(int(of(p)[0]) - (1 << 64) * 0.15))
    shared = of(passage)[0]

    def text(tag, lo, hi):
        """100 shingles, of which the shared one stands between lo and hi in the order, with equal ranks that of hashes."""
        for k in range(10_000):
            w = [f"{tag}{k}.{i}" for i in range(99)]
            t = " ".join([*w[:50], passage, *w[50:]])
            if lo <= np.searchsorted(of(t), shared) < hi:
                return t

    rows = [(1, text("a", 0, 15)), (2, text("b", 0, 15)), (3, text("c", 15, 26)), (4, text("d", 15, 26))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [sorted(r) for r in j.meetings(df, rank, 5, 75).collect()] == [[1, 2]]
