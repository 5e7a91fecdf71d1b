from collections import Counter, defaultdict

import numpy as np
import pytest

from evigrain.llm import line_dedup as l
from evigrain.llm.common import read_table


def brute(rows, documents=l.DOCUMENTS):
    """[(doc_id, text)] by plain loops over tokens, with sets instead of hashes."""
    mask = lambda t: "<*>" if any(c in "0123456789" for c in t) else t
    plain = lambda line: tuple(line.split())
    masked = lambda own: tuple(map(mask, own))
    split = lambda line: masked(plain(line))
    exact = [frozenset(plain(x) for x in (t or "").split("\n")) - {()} for _, t in rows]  # of each document
    held = defaultdict(list)  # line: its documents
    for n, lines in enumerate(exact):
        for ws in {masked(own) for own in lines}:
            held[ws].append(n)
    leaves = defaultdict(list)
    for ws in held:
        leaves[len(ws), ws[:3]].append(ws)
    # own lines: what tells documents apart whose lines begin alike, or end alike
    first, last = (lambda ws: ws[:3]), (lambda ws: ws[-3:])
    marked = {}
    for side, end, other in (("b", first, last), ("e", last, first)):
        texts = defaultdict(set)
        for lines in exact:
            texts[frozenset(end(masked(own)) for own in lines)].add(lines)
        for alike, those in texts.items():
            if len(those) < documents:
                continue
            counts = defaultdict(lambda: (Counter(), Counter(), Counter()))
            for lines in those:
                for own in lines:
                    for c, key in zip(counts[end(masked(own))], (own, other(own), masked(own))):
                        c[key] += 1
            for e, (lines_, others, forms) in counts.items():
                half = sum(lines_.values()) / 2
                if max(lines_.values()) < half and (max(others.values()) < half or max(forms.values()) >= half):
                    marked[side, alike, e] = True

    def place(n, ws, side, end):
        alike = frozenset(end(masked(own)) for own in exact[n])
        return side, alike - {end(ws)}, frozenset(own for own in exact[n] if masked(own) != ws and (side, alike, end(masked(own))) in marked)

    gone = set()
    for lines in leaves.values():
        groups = []
        for ws in sorted(lines, key=lambda ws: (-len(held[ws]), l.parse(" ".join(ws))[1])):
            fit = [g for g in groups if sum(a == b for a, b in zip(g[0], ws)) >= l.SIMILAR * len(ws)]
            if fit:
                fit[0].append(ws)
            else:
                groups.append([ws])
        for members in groups:
            # a document stands where its other lines' beginnings or ends are; those who share a place are alike
            classes = []
            for ws in members:
                for n in held[ws]:
                    places = {place(n, ws, "b", first), place(n, ws, "e", last)}
                    near = [c for c in classes if c & places]
                    classes = [c for c in classes if not c & places] + [places.union(*near)]
            if len(classes) >= documents:
                gone |= set(members)
    return sorted(((d, None if t is None else "\n".join(x for x in t.split("\n") if split(x) not in gone)) for d, t in rows), key=str)


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    words = [f"v{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    line = lambda n: " ".join(rng.choice(words, n))
    boiler, passage = "All rights reserved by us", line(60)
    rows = []
    for i in range(60):
        body = [line(int(rng.integers(5, 30))) for _ in range(4)]
        if i % 3 == 0:
            body.insert(int(rng.integers(0, 5)), boiler)
        if i % 4 == 0:
            body.insert(2, passage)
        if i % 5 == 0:
            body.append(f"Page {i} of 60 was printed at {i}:00 by user{i} in {words[i]} hall today")
        rows.append((i, "\n".join(body)))
    copied = rows[7][1]
    rows += [(100 + i, copied) for i in range(40)]
    for i in range(40):
        w = copied.split(" ")
        w[int(rng.integers(4, len(w)))] = "edited"
        rows.append((200 + i, " ".join(w)))
    return rows, boiler, passage


def test_templates_against_brute_force(spark):
    rows, boiler, passage = corpus()
    rows += [(500, None), (501, ""), (502, "\n\n \n"), (503, boiler), (504, ("z " * 50_000).strip())]
    df = spark.createDataFrame([(a, b, len(b or ""), 1) for a, b in rows], "doc_id long, text string, n_chars long, leaf int")
    joined = sorted(((r.doc_id, r.text) for r in l.clean(df, most=0).collect()), key=str)
    assert joined == brute(rows)
    got = l.clean(df)
    assert got.columns == df.columns
    got = got.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute(rows)
    assert all(r.n_chars == len(r.text or "") for r in got)
    text = {r.doc_id: r.text for r in got}
    before = dict(rows)
    assert not any(boiler in (t or "") or passage in (t or "") or "Page" in (t or "") for t in text.values())
    assert all(text[i] == before[i] for i in range(100, 140))  # copies are left to the near-duplicate stage
    assert all(len(text[i].split("\n")) == len(before[i].split("\n")) - (i % 3 == 0) - (i % 4 == 0) - (i % 5 == 0) for i in range(60))
    assert l.clean(df.limit(0)).count() == 0


def test_leaf_templates():
    lines = [x.split() for x in ("a b c d e f g h i j", "a b c d e f g h X Y", "a b c z z z z z z z", "a b c d e f g Q X Y", "a b c z z z z z z 1")]
    assert l.grow(lines) == [0, 0, 2, 0, 2]
    assert l.spelling([lines[k] for k in (0, 1, 3)]) == "a b c d e f g <*> <*> <*>" and l.spelling([lines[2]]) == "a b c z z z z z z z"


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = l.op8_line_dedup(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute(rows)
    before = dict(rows)
    assert all(r.n_lines == len(before[r.doc_id].split("\n")) and r.n_lines - r.n_dropped == len(r.text.split("\n")) or r.text == "" for r in got)


def test_leaves_larger_than_a_task(spark):
    """Rounds of any size give one task's result; no line is lost where a leaf holds more than a task does."""
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    rows = [(i, "\n".join(f"one leaf only {' '.join(rng.choice(words[: 3 + i % 4], 7))}" for _ in range(3)) + f"\n{own(i)}") for i in range(40)]
    rows += [(100 + i, f"one leaf only but this one {own(i, 0)} is read by very many people") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert want != sorted(rows, key=str)
    for at_most in ((40, 1 << 20), (l.LINES, 700), (7, 1 << 20), (l.LINES, l.TOKENS)):
        assert sorted(((r.doc_id, r.text) for r in l.clean(df, at_most=at_most).collect()), key=str) == want


def test_rounds_found_the_templates_of_one_task(spark):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in "aeiou"]
    tokens = sorted({"all in one " + " ".join(rng.choice(words[: 4 + k % 40], 5)) for k in range(30_000)})[:20_000]
    lines = [(7, k, t, 1, int(rng.integers(1, 4))) for k, t in zip(rng.permutation(len(tokens)).tolist(), tokens)]
    df = spark.createDataFrame(lines, "leaf long, line long, tokens string, companies long, documents long").withColumn("leaf", (l.F.lit(8 << l.HASH_BITS) + 7).cast("long")).withColumn("n", l.F.lit(len(lines)).cast("long"))
    whole = {r.line: r.template for r in l.found_templates(df).collect()}
    rounds = {r.line: r.template for r in l.in_rounds(df, 3000, 1 << 20).collect()}
    assert whole == rounds and len(whole) == 20_000 and 100 < len(set(whole.values())) < 20_000


def own(i, n=6):
    return f"alpha{'bcdefghij'[i % 9]}{'bcdefghij'[i // 9 % 9]}{'bcdefghij'[i // 81 % 9]}{'bcdefghij'[i // 729]} " + " ".join(f"w{chr(98 + (i * 7 + k * 5) % 24)}{chr(98 + i % 24)}{chr(98 + i // 24)}" for k in range(n))


def cleaned(spark, rows):
    return {r.doc_id: r.text for r in l.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_copies_do_not_hide_a_recurring_line(spark):
    passage = "this passage stands in many documents that are otherwise unlike"
    rows = [(i, f"{own(2 * i)}\n{passage}\n{own(2 * i + 1)}") for i in range(10)]
    rows += [(100 + i, f"first of the copies\n{passage}\nlast of the copies") for i in range(200)]
    got = cleaned(spark, rows)
    assert all(passage not in t for t in got.values())
    assert all(t == "first of the copies\nlast of the copies" for i, t in got.items() if i >= 100)
    assert all(got[i] == f"{own(2 * i)}\n{own(2 * i + 1)}" for i in range(10))


@pytest.mark.parametrize(("shared", "single"), [(8, 1), (10, 2), (30, 3), (10, 10), (2, 10)])
def test_boilerplate_does_not_hide_boilerplate(spark, shared, single):
    boiler = [f"boiler plate {chr(97 + k)} of the {chr(97 + k)} site" for k in range(26)] + [f"{c} {c} {c} plates" for c in "vwxy"]
    mine = lambda i: "\n".join(own(i * single + k) for k in range(single))
    got = cleaned(spark, [(i, "\n".join([*boiler[:shared], mine(i)])) for i in range(200)])
    assert got == {i: mine(i) for i in range(200)}


def test_near_copies_stay(spark):
    """Edits of a word at a line's beginning, in its midst or at its end leave a group of near copies one group."""
    base = [own(k, 9) for k in range(6)]
    rows = [(0, "\n".join(base))]
    for i in range(1, 60):
        ws = [x.split(" ") for x in base]
        ws[i % 6][i // 6] = f"edit{chr(98 + i % 24)}{chr(98 + i // 24)}"
        rows.append((i, "\n".join(map(" ".join, ws))))
    assert cleaned(spark, rows) == dict(rows)


def test_variants_in_a_document_count_it_once(spark):
    """Variants of a template hide nothing when their documents are unlike, and are no documents of their own."""
    post = lambda i, k: f"Posted today by n{chr(98 + i % 24)}{chr(98 + k)} in s{chr(98 + k)} news for all our many readers"
    rows = [(i, "\n".join([own(i), *(post(i, k) for k in range(6))])) for i in range(20)]
    assert cleaned(spark, rows) == {i: own(i) for i in range(20)}
    assert cleaned(spark, rows[:4]) == dict(rows[:4])


SHAPES = {
    "two own lines": lambda i: [own(2 * i), own(2 * i + 1)],
    "prose": lambda i: [own(i)],
    "a title": lambda i: [f"the title is {own(i, 2)}"],
    "a long title": lambda i: [f"the title is {own(i, 25)}"],
    "a form": lambda i: [f"name of author {own(i, 1)}", f"date of issue 2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}", f"place of work {['Berlin', 'Paris', 'Rome', 'Oslo'][i % 4]}"],
    "a short form": lambda i: [f"name of author {own(i, 0)}", f"place of work {['Berlin', 'Paris', 'Rome', 'Oslo'][i % 4]}"],
    "a log line": lambda i: [f"2024-01-{i % 28 + 1:02d} 10:{i // 60:02d}:{i % 60:02d} request {i} was served"],
    "a time stamp": lambda i: [f"2024-01-{i % 28 + 1:02d} 10:{i // 60:02d}:{i % 60:02d} this system is up and well"],
    "a log of lines": lambda i: [f"2024-01-01 10:{i // 60:02d}:{i % 60:02d} request {i * 10 + k} was served" for k in range(4)],
}


@pytest.mark.parametrize(("shape", "shared"), [*((shape, 10) for shape in SHAPES), ("a title", 1), ("a time stamp", 1)])
def test_boilerplate_beside_lines_of_any_form(spark, shape, shared):
    boiler = [f"footer {chr(97 + k)} says that {chr(97 + k)} rights are ours" for k in range(shared)]
    rows = [(i, "\n".join([*boiler[: shared // 2], *SHAPES[shape](i), *boiler[shared // 2 :]])) for i in range(200)]
    got = cleaned(spark, rows)
    assert sorted(got.items()) == sorted(brute(rows))
    assert not any(line in boiler for t in got.values() for line in t.split("\n"))
    if len(SHAPES[shape](0)) == 1:
        assert got == {i: SHAPES[shape](i)[0] for i in range(200)}


def test_copies_of_a_footer_stay(spark):
    rows = [(i, "\n".join(f"footer {c} says that {c} rights are ours" for c in "abcdef")) for i in range(200)]
    assert cleaned(spark, rows) == dict(rows)


@pytest.mark.parametrize(("size", "width", "edits"), [(60, 9, 1), (40, 30, 1), (12, 60, 2), (300, 12, 1)])
def test_near_copies_stay_whatever_their_size(spark, size, width, edits):
    """Words replaced at random places of random lines."""
    rng = np.random.default_rng(size)
    base, rows = [own(k, width) for k in range(8)], []
    for i in range(size):
        lines = [x.split(" ") for x in base]
        for _ in range(edits):
            k = int(rng.integers(len(base)))
            lines[k][int(rng.integers(3, len(lines[k]) - 3))] = f"edit{chr(98 + i % 24)}{chr(98 + i // 24)}"
        rows.append((i, "\n".join(map(" ".join, lines))))
    assert cleaned(spark, rows) == dict(rows)


def test_own_lines_with_repeated_ids_and_without_ids(spark):
    boiler = [f"footer {chr(97 + k)} says that {chr(97 + k)} rights are ours" for k in range(3)]
    rows = [(i // 2, "\n".join([*boiler, f"the title is {own(i, 2)}"])) for i in range(40)] * 2
    got = sorted((r.doc_id, r.text) for r in l.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute(rows)) and got == sorted((i // 2, f"the title is {own(i, 2)}") for i in [*range(40), *range(40)])
    # rows without an id are read, but nothing tells them apart from those alike
    lost = [(None, t) for _, t in rows[:40]]
    assert len({r.text for r in l.clean(spark.createDataFrame(lost, "doc_id long, text string")).collect()}) == 40


def test_shuffles_stay_few(spark):
    """Each shuffle costs the driver a task for each partition, so what has several sides is counted and joined at once."""
    boiler = [f"footer {chr(97 + k)} says that {chr(97 + k)} rights are ours" for k in range(3)]
    rows = [(i, "\n".join([*boiler, f"the title is {own(i, 2)}"])) for i in range(40)]
    rows += [(100 + i, "\n".join([own(k + (i == k) * 50, 9) for k in range(6)])) for i in range(6)]
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext
    sc.setJobGroup("few-shuffles", "")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.text for r in l.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("few-shuffles")]
        stages = {s for j in jobs for s in j.stageIds}
        full = [s for s in map(sc.statusTracker().getStageInfo, stages) if s and s.numCompletedTasks >= 16]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == dict(brute(rows)) and got[0] == f"the title is {own(0, 2)}"
    assert len(full) <= 28, len(full)
