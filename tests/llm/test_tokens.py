"""Counts and files against the library itself; Elias-Fano round trips."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from marquee.llm import token_files as tf
from marquee.llm.token_counts import count_tokens
from marquee.llm.tokens import Cache, Encoder, encoder
from tests.llm.fixtures import SCHEMA, documents, frame, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
ODD = ["a  b", "a \n b\n  c \t d  ", " x", "x ", "  ", "\n \n", "it's we'll 'tis <|endoftext|> end<|endoftext|>\n <|endoftext|>",
       "1234 5²x ½", "中文 字 😀 a  b  c", "\x1c a\x1c  b", "...!!! ?", "<|endof text|>", "\x85 \x85", "ǅ ɐ ɏ",
       "nul\0 in \0it", "\0"]


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def test_parts_give_the_librarys_ids():
    enc = encoder(PATH)
    for t in ODD + [r[1] or "" for r in documents()]:
        assert np.frombuffer(enc.ids(t), np.uint16).tolist() == ids(t), t


def test_every_character_alone_and_in_company():
    enc = Encoder(PATH)
    for a in (0, 0x2000, 0x1F600):
        said = [t for c in map(chr, range(a, a + 0x250))
                for t in (c, f"a{c}b {c} 1{c}", f"x {c}{c}  {c}\n", f"{c} a", f"'s{c}'re {c}!")]
        for t, got in zip(said, enc.encode(said)):
            assert np.frombuffer(got, np.uint16).tolist() == ids(t), t


def test_the_cache_is_bounded_in_bytes():
    cache = Cache(100_000)
    for i in range(500):
        cache.settle()
        keys = [f"key{i}-{k}" for k in range(10)] + ["often"]
        new = cache.missing(keys)
        assert "often" not in new or not i
        cache.add(new, [b"12"] * len(new))
        assert set(keys) <= set(cache.new) and len(cache.new) + len(cache.old) < 620
    cache.add(["x" * 1000], [b"12"])
    assert cache.new["x" * 1000] == b"12"
    cache.settle()
    assert cache.missing(["x" * 1000, "key0-0", "often"]) == ["x" * 1000, "key0-0"]
    enc = Encoder(PATH)
    enc.cache = Cache(20_000)
    texts = [r[1] or "" for r in documents()] + ["字" * 15_000, "word" * 9_000]
    assert [np.frombuffer(x, np.uint16).tolist() for x in enc.encode(texts)] == [ids(t) for t in texts]


@given(st.lists(st.sampled_from(["a", "Bc", " ", "  ", "\n", "\t", "'s", "!", "9", "é", "\xa0", "<|endoftext|>", "中"]), max_size=14))
@settings(max_examples=400, deadline=None)
def test_random_texts(pieces):
    t = "".join(pieces)
    assert np.frombuffer(encoder(PATH).ids(t), np.uint16).tolist() == ids(t)


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, lib = Encoder(path), Tokenizer.from_file(path)
    assert not enc.byte_level
    assert np.frombuffer(enc.ids("Some Words, here"), np.uint16).tolist() == lib.encode("Some Words, here", add_special_tokens=False).ids


def rows():
    return documents() + [(7000 + i, t, "en", "s", 1) for i, t in enumerate(ODD)]


@pytest.mark.parametrize("head_docs", [20_000, 9])
def test_counts(spark, head_docs):
    data = rows()
    got = count_tokens(with_clashes(frame(spark, data)), PATH, head_docs=head_docs).collect()
    want = [(r[0], len((r[1] or "").encode()), len(ids(r[1])), len(ids(r[1])) > 512) for r in data]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert count_tokens(spark.createDataFrame([], SCHEMA), PATH).collect() == []


@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.integers(0, 60))
@settings(max_examples=150, deadline=None)
def test_elias_fano(values, shift):
    v = sorted(x >> shift for x in values)
    data = tf.ef_encode(np.array(v, np.uint64))
    assert tf.ef_decode(data).tolist() == v
    assert [tf.ef_select(data, i) for i in range(len(v))] == v


def test_boundaries_take_few_bits():
    ends = np.cumsum(np.random.RandomState(1).randint(1, 800, 20_000))
    assert len(tf.ef_encode(np.r_[0, ends])) * 8 / 20_001 < 2.6 + np.log2(ends[-1] / 20_001)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_files(spark, tmp_path, block):
    data = rows() + [(-5, "negative id", "en", "s", 1)]
    out = str(tmp_path / "tokens")
    tf.write_token_files(with_clashes(frame(spark, data)), PATH, out, block_ids=block)
    got = tf.read_token_files(spark, out).collect()
    want, start = [], 0
    for r in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        own = [*ids(r[1]), 2]
        want.append((r[0], start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    raw = spark.read.parquet(f"{out}/blocks").orderBy("shard", "block").collect()
    assert [i for r in raw for d in [tf.Block(r["data"])] for k in range(d.n_docs) for i in d.document(k)] == \
        [i for r in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")) for i in [*ids(r[1]), 2]]


def test_read_back_goes_by_select(monkeypatch):
    sizes = [1 + (k * 37) % 11 for k in range(300)]
    ends = np.cumsum(sizes).tolist()
    data = tf.encode_block([None, *range(299)], ends, np.arange(ends[-1], dtype="<u2").tobytes(), 2)
    asked, select = [], tf.ef_select
    monkeypatch.setattr(tf, "ef_select", lambda d, i: asked.append(i) or select(d, i))
    batch = pa.RecordBatch.from_arrays([pa.array([1000], pa.int64()), pa.array([data])], names=["base", "data"])
    got = next(tf._read([batch])).to_pydict()
    assert set(asked) == set(range(301))
    assert got["doc_id"] == [None, *range(299)] and got["n_tokens"] == sizes
    assert got["start"] == [1000 + e - n for e, n in zip(ends, sizes)]
    assert got["ids_crc32"] == [zlib.crc32(np.arange(e - n, e, dtype="<u4").tobytes()) for e, n in zip(ends, sizes)]


def test_no_rows(spark, tmp_path):
    tf.write_token_files(spark.createDataFrame([], SCHEMA), PATH, str(tmp_path / "t"))
    assert tf.read_token_files(spark, str(tmp_path / "t")).collect() == []


def test_each_distinct_pretoken_is_counted_once(monkeypatch):
    """Runs over batch borders, rows without a pre-token between them."""
    from marquee.llm import token_counts as tc
    enc, seen = Encoder(PATH), []
    resolve = enc.resolve
    enc.resolve = lambda parts: seen.extend(parts) or resolve(parts)
    monkeypatch.setattr(tc, "encoder", lambda path: enc)
    rows = [("\0 1 2", 0, 7)] + sorted((p, n, 0) for p in (" a", " zebra", "wörter", "x" * 300) for n in range(1, 6))

    def batches():
        for lo in range(0, len(rows), 3):
            some = rows[lo:lo + 3]
            yield pa.RecordBatch.from_pydict({"doc_id": [1] * len(some), "text_hash": [2] * len(some), "n_bytes": [None] * len(some),
                                              "piece": [r[0] for r in some], "n": [r[1] for r in some], "known": [r[2] for r in some]})
    got = [t for b in tc._run_counts(PATH)(batches()) for t in b.column("tokens").to_pylist()]
    assert got == [k if not n else n * len(ids(p)) for p, n, k in rows]
    assert sorted(seen) == sorted({r[0] for r in rows if r[1]})


def test_long_pretokens_stay_in_their_document(spark):
    texts = ["a" * 600 + " b", "字" * 700, "a" * 600, " " + "zz" * 400 + " ends"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    assert {r.doc_id: r.n_tokens for r in count_tokens(frame(spark, rows), PATH).collect()} == {i: len(ids(t)) for i, t in enumerate(texts)}
