"""Byte-level BPE by a trie of the distinct words, and its inverse.

In a byte-level BPE the encoding of a prefix is settled by its last token: the
one token that ends the prefix, whose own encoding is itself, and that is
stable beside the last token of what is before it (no merge across their
border comes first). So the words of a step are put into a trie, and a walk
depth-first hands every node the last tokens of the prefixes above it; a prefix
that many words share is worked out once. Reading a word's last tokens
backwards gives its ids. Decoding concatenates the tokens' bytes.

Documents stay where they are: each task cuts its texts into words, inserts the
distinct ones that it does not know yet, and looks the ids of its texts up.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import frees, kept_by_worker, steps
from marquee.llm.tokens import Parts, byte_letters, encoder
from marquee.session import ship_package

#: Verdicts on token pairs that a worker keeps (a number each) before it
#: starts anew.
PAIRS = 400_000


def _plain(path: str) -> dict:
    """The tokenizer file, if it is a plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    if spec["model"].get("type") != "BPE" or spec.get("normalizer") or any(map(spec["model"].get, odd)):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    return spec


def _special(spec: dict) -> dict[int, bytes]:
    return {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}


def token_bytes(path: str) -> list[bytes]:
    """What each id of a tokenizer file stands for."""
    spec = _plain(path)
    back = {letter: b for b, letter in byte_letters().items()}
    vocab, special = spec["model"]["vocab"], _special(spec)
    out = [b""] * (1 + max([*vocab.values(), *special]))
    for letters, i in vocab.items():
        if i not in special:
            out[i] = bytes(back[ord(c)] for c in letters)
    for i, said in special.items():
        out[i] = said
    return out


def decode(said_by: list[bytes], ids) -> str:
    return b"".join(map(said_by.__getitem__, ids)).decode("utf-8", "replace")


class Bpe:
    """The tokens, merges and pair verdicts of a tokenizer file."""

    def __init__(self, path: str):
        spec = _plain(path)
        model = spec["model"]
        vocab = model["vocab"]
        self.special = _special(spec)
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} has added tokens that take in white space or words")
        self.bytes = token_bytes(path)
        # A merge: its rank and the token it makes; a token: the merge it is from.
        self.merge: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            if max(self.rank.get(x, -1), self.rank.get(y, -1)) >= rank:
                raise ValueError(f"merge {rank} of {path} comes before its parts")
            self.merge[x, y] = rank
            self.rank.setdefault(made, rank)
            self.halves.setdefault(made, (x, y))
        #: The tokens that are their own encoding, by their bytes.
        self.whole: dict[bytes, int] = {}
        good = set()
        for i in sorted((i for i in vocab.values() if i not in self.special), key=lambda i: self.rank.get(i, -1)):
            if i not in self.halves and len(self.bytes[i]) > 1:
                continue
            if i in self.halves:
                x, y = self.halves[i]
                if not (x in good and y in good and self._stable(x, y, self.rank[i])):
                    continue
            good.add(i)
            self.whole[self.bytes[i]] = i
        if sum(len(b) == 1 for b in self.whole) < 256:
            raise ValueError(f"{path} does not know every byte")
        #: What any token begins with, and the tokens that end it, longest
        #: first (worked out when first met).
        self.ends: dict[bytes, tuple | None] = {b[:k]: None for b in self.whole for k in range(1, len(b) + 1)}
        self.pairs: dict[int, bool] = {}

    def _stable(self, x: int, y: int, until: int) -> bool:
        """Whether no merge across the border of ``x`` and ``y`` comes before
        the rank ``until``. The two pieces at the border merge if their pair's
        rank is below that of the next merge on the left (of two equal pairs
        the left one goes first) and not above that of the next on the right;
        time runs backwards, the latest merge is undone first."""
        rank, halves, merge = self.rank, self.halves, self.merge
        x_ends = y_ends = until
        while True:
            r = merge.get((x, y))
            if r is not None and r < x_ends and r <= y_ends and r < until:
                return False
            a, b = rank.get(x, -1), rank.get(y, -1)
            if a > b:
                x_ends, x = a, halves[x][1]
            elif b >= 0:
                y_ends, y = b, halves[y][0]
            else:
                return True

    def stable(self, x: int, y: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        ok = self.pairs[x << 32 | y] = self._stable(x, y, len(self.merge))
        return ok

    def _ending(self, said: bytes) -> tuple:
        found = self.ends[said] = tuple(
            (len(said) - k, self.whole[said[k:]]) for k in range(len(said)) if said[k:] in self.whole)
        return found

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. Sorted, the words are their trie depth-first: a
        word goes down from the node where it leaves the one before it, and
        ``last`` is the path of last tokens from the root to it; ``since`` is
        where the longest run of bytes begins that may yet become a token."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list[list[int]] = [[]] * len(words)
        ends, pairs = self.ends.get, self.pairs
        last, since = [-1], [0]
        before = b""
        for at in order:
            w = words[at]
            n, d = len(w), 0
            most = min(n, len(before))
            if w[:most] == before[:most]:
                d = most
            else:
                while w[d] == before[d]:
                    d += 1
            del last[d + 1:], since[d + 1:]
            lo = since[d]
            for end in range(d + 1, n + 1):
                found = ends(w[lo:end], 0)
                while found == 0:
                    lo += 1
                    found = ends(w[lo:end], 0)
                for size, t in found or self._ending(w[lo:end]):
                    if size == end:
                        break
                    p = last[end - size]
                    ok = pairs.get(p << 32 | t)
                    if ok or ok is None and self.stable(p, t):
                        break
                last.append(t)
                since.append(lo)
            ids = []
            while n:
                t = last[n]
                ids.append(t)
                n -= len(self.bytes[t])
            ids.reverse()
            out[at] = ids
            before = w
        return out



class TrieEncoder(Parts):
    """Ids by the trie; special strings inside texts are their own tokens, as
    the library's default has it."""

    def __init__(self, path: str):
        super().__init__(path)
        self.bpe = Bpe(path)
        self.special_ids = {said.decode(): i for i, said in self.bpe.special.items()}

    def resolve(self, parts: list[str]) -> list[bytes]:
        special = self.special_ids
        ids = self.bpe.encode_words([b"" if p in special else p.encode() for p in parts])
        return [array(self.code, [special[p]] if p in special else own).tobytes() for p, own in zip(parts, ids)]


_BYTES: dict[str, list[bytes]] = {}
kept_by_worker(_BYTES.clear)


@frees
def _encode(batches, path: str):
    enc = encoder(path, TrieEncoder)
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        for lo, hi in steps(texts):
            ids = [np.frombuffer(x, f"<u{enc.width}").astype("<u4").tobytes() for x in enc.encode(texts[lo:hi])]
            rows = b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.binary())], names=[*b.schema.names, "ids"])


@frees
def _decode(batches, path: str, name: str):
    if path not in _BYTES:
        _BYTES[path] = token_bytes(path)
    said_by = _BYTES[path]
    for b in batches:
        column = b.column("ids")
        lo = 0
        # A step holds about as many ids as one of texts holds characters.
        for hi in _cuts(column):
            said = [decode(said_by, np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in column.slice(lo, hi - lo)]
            rows = b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(said, pa.string())], names=[*b.schema.names, name])
            lo = hi


def _cuts(column, limit: int = 4 << 20):
    size = 0
    for i, x in enumerate(column):
        size += len(x.as_buffer()) if x.is_valid else 0
        if size >= limit or i + 1 == len(column):
            yield i + 1
            size = 0


def _with(df: DataFrame, name: str, kind: str) -> str:
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], f"{name} {kind}"])


def encode_texts(df: DataFrame, path: str) -> DataFrame:
    """``df`` with ``ids``: those of ``text`` by the byte-level BPE of the
    tokenizer file ``path``, as little-endian unsigned 32-bit integers. No
    token is added; special strings inside texts are their tokens. Null text
    has no ids, as the empty one; whole texts, however long; repeated rows are
    rows; an empty table stays empty; a column ``ids`` must not be there."""
    ship_package(df.sparkSession)
    rows = df.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(lambda batches: _encode(batches, path), _with(rows, "ids", "binary"))


def decode_ids(df: DataFrame, path: str, name: str = "decoded") -> DataFrame:
    """``df`` with ``name``: the text of its ``ids``, special tokens included.
    Null ids give the empty text; bytes that are no UTF-8 (ids of another
    tokenizer) the replacement character."""
    ship_package(df.sparkSession)
    return df.mapInArrow(lambda batches: _decode(batches, path, name), _with(df, name, "string"))
