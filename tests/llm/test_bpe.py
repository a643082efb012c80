"""The trie's ids and its inverse against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from marquee.llm import bpe
from marquee.llm.queries import QUERIES
from marquee.llm.tokens import Cache
from tests.conftest import SF001
from tests.llm.fixtures import SCHEMA, documents, frame, with_clashes
from tests.llm.test_tokens import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
ENC = bpe.TrieEncoder(PATH)


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def mine(texts):
    return [np.frombuffer(x, np.uint16).tolist() for x in ENC.encode(texts)]


def test_words_share_their_prefixes():
    model, rng = bpe.Bpe(PATH), random.Random(3)
    words = {"".join(rng.choice("etaoinshr'19 é") for _ in range(rng.randint(1, 12))).strip() or "x" for _ in range(3000)}
    words |= {c * n for c in "aeé字" for n in (1, 2, 3, 7, 50, 129, 400)} | {"ab" * n for n in range(1, 200)}
    words = sorted(w.encode() for w in words)
    letters = bpe.byte_letters()
    want = [[t.id for t in LIB.model.tokenize(w.decode("latin-1").translate(letters))] for w in words]
    assert model.encode_words(words) == want
    # any order, repeated words and no words
    assert model.encode_words(words[::-1] + words) == want[::-1] + want and model.encode_words([]) == []


def test_odd_texts_and_awkward_rows():
    texts = ODD + [r[1] or "" for r in documents()] + ["字" * 15_000, "word" * 9_000, " " * 500, "\n" * 301]
    assert mine(texts) == [ids(t) for t in texts]
    assert [bpe.decode(bpe.token_bytes(PATH), x) for x in mine(texts)] == [LIB.decode(ids(t), skip_special_tokens=False) for t in texts] == texts


@given(st.lists(st.sampled_from(["a", "Bc", " ", "  ", "\n", "\t", "'s", "!", "9", "é", "\xa0", "<|endoftext|>", "中", "\u1e9e", "١"]), max_size=14))
@settings(max_examples=400, deadline=None)
def test_random_texts(pieces):
    t = "".join(pieces)
    assert mine([t]) == [ids(t)]


def test_a_small_cache_changes_nothing():
    enc = bpe.TrieEncoder(PATH)
    enc.cache = Cache(10_000)
    texts = [r[1] or "" for r in documents()]
    for lo in range(0, len(texts), 7):
        assert enc.encode(texts[lo:lo + 7]) == ENC.encode(texts[lo:lo + 7])


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))


def test_tables(spark):
    rows = documents() + [(7000 + i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    out = bpe.decode_ids(bpe.encode_texts(with_clashes(frame(spark, rows)), PATH), PATH)
    assert out.columns == [*with_clashes(frame(spark)).columns, "ids", "decoded"]
    got = sorted((r.doc_id or -1, r.text or "", np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in out.collect())
    assert got == sorted((r[0] or -1, r[1] or "", ids(r[1]), r[1] or "") for r in rows)
    empty = bpe.decode_ids(bpe.encode_texts(frame(spark, []), PATH), PATH)
    assert empty.collect() == []
    with pytest.raises(ValueError):
        bpe.encode_texts(frame(spark).withColumnRenamed("lang", "ids"), PATH)
    strange = spark.createDataFrame([(1, b"\xff\x01\0\0"), (2, None)], "k int, ids binary")
    assert [r.decoded for r in bpe.decode_ids(strange, PATH).orderBy("k").collect()] == [LIB.decode([511]), ""]


def test_query(spark):
    docs = [r for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    want = []
    for d, t in docs:
        x = ids(t)
        back = LIB.decode(x, skip_special_tokens=False)
        want.append((d, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    df = QUERIES["op12_bpe_codec"](spark, SF001)
    assert dict(df.dtypes)["n_tokens"] == "bigint"
    assert sorted(map(tuple, df.collect())) == sorted(want) and SCHEMA
