"""Token ids by a tokenizer file of the ``tokenizers`` library, with the work
done once per distinct pre-token that a task meets.

A byte-level BPE never joins across pre-tokens, so these are encoded on their
own. The distinct ones of a step of texts are looked up in a cache of the
worker, bounded in bytes; the missing ones go through the library together.
Tokenizers of another kind get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from marquee.llm.common import kept_by_worker

#: Bytes of a worker's cache of parts, and of a part that is kept there.
CACHE_BYTES, PART_BYTES = 128 << 20, 256
#: What Python adds to the bytes of a key and its value.
ENTRY_BYTES = 190
#: Parts that go through the library at once.
TOGETHER = 500

_SPLIT = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s ")
_PLAIN = re.compile(r" ?\S+")

# The pre-token pattern of byte-level BPE, spelled out for the
# characters below U+0250 (the library cuts parts with others).
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PRE = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_FAR = re.compile("[^\x00-ɏ]")

def pretokens(text: str) -> list[str]:
    """``text`` cut before every space that follows a non-space."""
    if not text:
        return []
    if "\0" in text or _ODD.search(text):
        return _SPLIT.split(text)
    return text.replace(" ", "\0 ").split("\0")


def byte_letters() -> dict[int, int]:
    """Byte to letter of byte-level BPE: printable Latin-1 stands for itself,
    the other bytes follow from U+0100 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: b for b in own}, **{b: 256 + i for i, b in enumerate(rest)}}


class Cache:
    """Values by key within about ``limit`` bytes, as two generations: what is
    not asked for during a whole generation goes with it. ``new`` holds all
    keys of the last step, long ones too, until the next one settles it."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.half, self.held = limit // 2, 0
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def settle(self) -> None:
        for key in self.long:
            del self.new[key]
        self.long = []
        if self.held > self.half:
            self.old, self.new, self.held = self.new, {}, 0

    def missing(self, keys) -> list[str]:
        """The distinct ``keys`` that are in no generation; those of the old
        one move to the new one."""
        new, old = self.new, self.old
        out = [k for k in keys if k not in new]
        if old:
            known = [k for k in out if k in old]
            self.add(known, map(old.pop, known))
            out = [k for k in out if k not in new]
        return out

    def add(self, keys: list[str], values) -> None:
        new = self.new
        for key, value in zip(keys, values):
            new[key] = value
            size = len(key) + len(value)
            if size > PART_BYTES:
                self.long.append(key)
            else:
                self.held += size + ENTRY_BYTES


class Parts:
    """Texts to packed little ids by their parts; ``resolve`` gives the ids of
    parts that the cache does not know."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.byte_level = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                           and not pre.get("add_prefix_space") and spec.get("normalizer") is None
                           and spec["model"].get("type", "BPE") == "BPE")
        added = spec.get("added_tokens", [])
        self.byte_level &= not any("\n" in t["content"] or t.get("lstrip") or t.get("rstrip")
                                   or t.get("single_word") for t in added)
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special_re = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        if self.byte_level:
            from tokenizers.pre_tokenizers import ByteLevel
            self.cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.code = "H" if len(spec["model"].get("vocab", ())) + len(added) <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.cache = Cache()

    def parts(self, text: str) -> list[str]:
        """The pre-tokens of a text and its special strings, in order."""
        if not self.byte_level:
            return [text]
        if self.special_re and self.special_re.search(text):
            out = []
            for i, piece in enumerate(self.special_re.split(text)):
                out += [piece] if i % 2 else self._words(piece)
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if text.isascii() or not _FAR.search(text):
            return _PRE.findall(text)
        out = []
        for part in pretokens(text):
            if _FAR.search(part):
                out += [part[a:b] for _, (a, b) in self.cut(part)]
            else:
                out += _PRE.findall(part)
        return out

    def lookup(self, parts) -> dict[str, bytes]:
        """A dictionary with the packed ids of each of the distinct ``parts``."""
        cache = self.cache
        cache.settle()
        missing = cache.missing(parts)
        cache.add(missing, self.resolve(missing))
        return cache.new

    def ids(self, text: str) -> bytes:
        return self.encode([text])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = list(map(self.parts, texts))
        known = self.lookup(set().union(*split)).__getitem__
        return [b"".join(map(known, own)) for own in split]

    def resolve(self, parts: list[str]) -> list[bytes]:
        raise NotImplementedError


class Encoder(Parts):
    """Ids by the library. Parts without white space inside go through it many
    at once, a line each; a line's end is a token of its own there."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from tokenizers import Tokenizer
        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        end = self._raw("\n")
        self.line_end = end[0] if self.byte_level and len(end) == 1 else None

    def _raw(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def resolve(self, parts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(parts)
        plain = []
        for i, p in enumerate(parts):
            if self.line_end is not None and _PLAIN.fullmatch(p):
                plain.append(i)
            else:
                out[i] = array(self.code, self._raw(p)).tobytes()
        for lo in range(0, len(plain), TOGETHER):
            some = plain[lo:lo + TOGETHER]
            ids = np.array(self._raw("\n".join([parts[i] for i in some]) + "\n"), dtype=f"<u{self.width}")
            ends = np.flatnonzero(ids == self.line_end)
            if len(ends) != len(some):
                raise ValueError("a part holds a line end")
            packed, at = ids.tobytes(), 0
            for i, end in zip(some, (ends * self.width).tolist()):
                out[i] = packed[at:end]
                at = end + self.width
        return out


_ENCODERS: dict[tuple, Parts] = {}
kept_by_worker(_ENCODERS.clear)


def encoder(path: str, kind: type[Parts] = Encoder) -> Parts:
    """The worker's encoder of a tokenizer file. It keeps many small objects
    for long, so the collector's generations are frozen."""
    if (kind, path) not in _ENCODERS:
        import gc
        _ENCODERS[kind, path] = kind(path)
        gc.freeze()
        gc.set_threshold(200_000, 50, 100)
    return _ENCODERS[kind, path]
