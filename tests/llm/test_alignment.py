import hashlib
import json
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evigrain.llm import alignment as al

PATHS = P.path(al.A_FILE), P.path(al.B_FILE)
TEXTS = ["The quick brown fox's", "naïve façade — 東京タワー 🤖🤖", "a  b\n\n\tc", "has ▁ inside", "<|endoftext|> and <s> and <unk> <0x0A>", "x\x00y", " lead", "\n", "ﬁne 1234567 89", "é", "The the The the , , ."]


def brute(rows):
    """The contract, token by token, for (doc_id, text)."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in visible)}
    names = {i: t for t, i in json.load(open(PATHS[0], encoding="utf-8"))["model"]["vocab"].items()}
    found = []
    for doc, text in rows:
        if not text:
            found.append((doc, [], [], []))
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ba = [bytes(letter[c] for c in names[i]) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        if not b"".join(ba) == b"".join(bb) == b" " + text.encode():
            found.append((doc, [], [], []))
            continue
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        ea, eb = ends(ba), ends(bb)
        links = [(x, y) for x, p in zip(ia, ea) for y, q in zip(ib, eb) if p == q]
        groups, x, y = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            groups.append(",".join(str(i) for i, e in zip(ia, ea) if x < e <= cut) + "|" + ",".join(str(i) for i, e in zip(ib, eb) if y < e <= cut))
            x = y = cut
        found.append((doc, ia, ib, links, groups))
    count = Counter(pair for f in found for pair in f[3])
    best = {}
    for (_, y), n in count.items():
        best[y] = max(n, best.get(y, 0))
    out = []
    for doc, ia, ib, links, *groups in found:
        text = ";".join(groups[0]) if groups else None
        digest = hashlib.sha256(text.encode()).hexdigest() if text is not None else ""
        out.append((doc, len(ia), len(ib), len(groups[0]) if groups else 0, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), digest))
    return out


def test_equals_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 3)] + [(7, None), (None, "The"), (8, ""), (3, "The")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, groups_sha256 string, batch int").repartition(3)
    want = sorted(brute(rows), key=str)
    assert any(w[1] == 0 for w in want)
    for options in ({}, {"run": 40, "cells": 3, "most": 2}):  # many batches; stripes dealt over many tasks
        got = al.align_table(df, *PATHS, **options)
        assert got.columns == [c.split()[0] for c in al.RESULT.split(", ")]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert al.align_table(df.limit(0), *PATHS).count() == 0


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("n_chars < 1200").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute(rows))
    assert any(w[5] < w[4] for w in want) and sum(w[4] for w in want) > 5000
    assert sorted(map(tuple, al.align_table(df, *PATHS).collect())) == want


def test_long_text(spark):
    text = "word soup, naïve " * 60_000
    got = al.align_table(spark.createDataFrame([(1, text), (2, "word")], "doc_id long, text string"), *PATHS).orderBy("doc_id").collect()
    assert got[0].n_links == got[0].n_groups > 60_000 and got[0].count_sum > 60_000**2 and got[1].n_best == 1


def test_byte_letters():
    assert sorted(al.byte_letters().values()) == list(range(256)) and al.byte_letters()["Ġ"] == 32


@pytest.mark.parametrize("text", TEXTS)
def test_entries_join_to_the_text(text):
    own = al.aligner(*PATHS)
    ids = own.a.encode([text])[0]
    assert own.a.vocabulary.joined(ids).tobytes() == (" " + text).encode()


def test_merging_by_ranks_equals_the_tokenizer(spark, sf_dir):
    fast, slow = al.ByteLevel(PATHS[0]), al.ByteLevel(PATHS[0], ranks=False)
    assert fast.words is not None and slow.words is None
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += [" ".join(f"a{chr(c)}b1{chr(c)}{chr(c)} {chr(c)}\n{chr(c)} !{chr(c)}!" for c in points[k : k + 50]) for k in range(0, len(points), 350)]
    for a, b, t in zip(fast.encode(texts), slow.encode(texts), texts):
        assert a.tolist() == b.tolist(), t


def test_ranks_are_not_used_where_merges_differ(tmp_path):
    spec = json.load(open(PATHS[0], encoding="utf-8"))
    merges = spec["model"]["merges"]
    spec["model"]["merges"] = [*merges[1:200], merges[0], *merges[200:]]
    changed = tmp_path / "v.json"
    changed.write_text(json.dumps(spec), encoding="utf-8")
    assert al.ByteLevel(str(changed)).words is None
