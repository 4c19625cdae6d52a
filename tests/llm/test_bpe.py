import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimforge.llm import bpe


@pytest.fixture(scope="module")
def judge():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("abehinorst ", max_size=60))
def test_same_ids_as_an_independent_encoder(judge, text):
    encoder = bpe.encoder()
    ids = encoder.encode(text)
    assert ids == judge.encode_ordinary(text)
    assert encoder.decode(np.array(ids, np.int64)).decode() == text


@pytest.mark.parametrize("text", ["a" * 20_000, "=-" * 3_000, " " * 999, "<|endoftext|>", "\u0000﻿\n\n"])
def test_long_and_odd_texts(judge, text):
    assert bpe.encoder().encode(text) == judge.encode_ordinary(text)


def test_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "  ", 9), (4, "Größe 東京 👩‍🔧", 9), (4, "Größe 東京 👩‍🔧", 9), (None, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r.doc_id or 0, r.ids) for r in bpe.encode_texts(df).collect())
    assert len(got) == 6 and got[1] == (1, []) and got[2] == (2, [])
    back = {r.doc_id: r.text for r in bpe.decode_ids(bpe.encode_texts(df)).collect()}
    assert back[4] == "Größe 東京 👩‍🔧" and back[1] == ""
    assert bpe.encode_texts(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()}[2] == 0
