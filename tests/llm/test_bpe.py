import base64
import hashlib

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken

from evigrain.llm import bpe

TEXTS = ["", " ", "\n\n  \t", "The quick brown fox's", "naïve façade — 東京タワー 🤖🤖", "a" * 3000, "x\x00y‍", "  lead", "1234567 89", "<|endoftext|>"]


def reference():
    ranks = bpe.load_ranks(P.path(bpe.VOCABULARY))
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_tiktoken_and_round_trip():
    ranks, enc = reference()
    c = bpe.Coder(ranks, P.PATTERN)
    ids, at = c.encode(TEXTS * 2)
    for t, x, y in zip(TEXTS * 2, at[:-1], at[1:]):
        assert ids[x:y].tolist() == enc.encode_ordinary(t)
        assert c.decode(ids[x:y]) == t.encode()


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot.tolist()) == list(range(5000))
    import pyarrow as pa

    found = h.find(pa.array([b"k7", b"zz", b"", b"k4999"], pa.binary()))
    assert found.tolist() == [7, -1, -1, 4999]


def test_table_with_nulls_and_extra_columns(spark):
    ranks, enc = reference()
    long = "ab" * 300_000 + " word" * 200_000
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello wörld", "z"), (3, "Hello wörld", "z"), (4, long, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    got = sorted(bpe.encode_table(df, P.path(bpe.VOCABULARY), P.PATTERN).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.n_tokens for r in got[:2]] == [0, 0] and got[0].ids_sha256 == got[0].decoded_sha256 == empty
    want = enc.encode_ordinary("Hello wörld")
    assert got[2].n_tokens == len(want) and got[2] == got[3]
    assert got[2].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert got[4].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest() and got[4].ids_sha256 == hashlib.sha256(np.array(enc.encode_ordinary(long), "<u4").tobytes()).hexdigest()
    with pytest.raises(ValueError, match="lacks"):
        bpe.Coder({b"a": 0}, P.PATTERN)
    assert bpe.encode_table(df.limit(0), P.path(bpe.VOCABULARY), P.PATTERN).count() == 0
