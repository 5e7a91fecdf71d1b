import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evigrain.llm import packing
from evigrain.llm.common import read_table

PATH = P.path(packing.VOCABULARY)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 30))
def test_best_fill_is_the_best(counts, capacity):
    used = packing.best_fill(counts, capacity)
    assert all(n <= counts[s] for s, n in used.items())
    sums = {sum(s * n for s, n in zip(counts, c)) for c in itertools.product(*[range(n + 1) for n in counts.values()])}
    assert sum(s * n for s, n in used.items()) == max(x for x in sums if x <= capacity)


def test_plan_uses_every_piece_once():
    counts = {4096: 3, 4000: 7, 96: 5, 50: 11, 46: 4, 1: 9}
    plan = packing.plan_windows(counts)
    total = defaultdict(int)
    for used, times in plan:
        assert sum(s * n for s, n in used.items()) <= 4096
        for s, n in used.items():
            total[s] += n * times
    assert dict(total) == counts


def test_chunks_equal_whole_texts():
    t = Tokenizer.from_file(PATH)
    texts = ["", " ", "It's  a\ttest\n\nOf Ünïcode, é ΣΑΣ. <|endoftext|> 12 34!!", "İstanbul ̈x", "a" * 500, "日本語 テスト　x y\x1cz"]
    from evigrain.llm.common import utf8_view
    import pyarrow as pa

    texts += ["Le. le, LE ,le le.. É é. ªº µ ß.", "word\nword word\n", "don't I'll ' 's", "J\u030c E\u0301 I\u0307.", "ÀÉ×÷ÿ. Æ,b 3.14,x a.,b ..c c. d.\n. ,", "ends.", ",starts", ".", "ǰ Ω. Я, x.Я"]
    texts += ["a<|endoftext|>b", "<|startoftext|> x. <|ENDOFTEXT|> <|endoftext|", "<|endoftext|><|endoftext|>", "plain again"]
    ids, at = packing.ChunkTokenizer(PATH).encode(*utf8_view(pa.array(texts)))
    for text, x, y in zip(texts, at[:-1], at[1:]):
        assert ids[x:y].tolist() == t.encode(text, add_special_tokens=False).ids


def check(rows, texts, window=4096):
    t = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(by_seq)


def test_small_table(spark):
    rows = [(1, None), (2, ""), (3, "hello world " * 3000), (4, "x"), (5, "x"), (6, "some words here"), (7, "the end <|endoftext|> is near")]
    df = spark.createDataFrame([(*r, 9, "r", 1) for r in rows], "doc_id long, text string, length int, rank string, sequence_id int")
    check(packing.pack(df, PATH).collect(), dict(rows))
    assert packing.pack(df.limit(0), PATH).count() == 0
    twice = packing.pack(df.unionByName(df), PATH).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.length for r in packing.pack(df, PATH).collect())


def test_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = packing.op4_packing(spark, sf_dir).collect()
    n = check(got, texts)
    assert n == -(-sum(r.length for r in got) // 4096)
