"""Benchmark decontamination with one Aho-Corasick automaton.

Normalised words are the runs of a-z, 0-9 and non-ASCII characters after
lower-casing A-Z. Every window of ``window`` consecutive words of a benchmark
text (a shorter text is one window) is one key of the automaton, bounded by
spaces; a document's normalised words, joined by spaces, are scanned once. Hits
map back to words, and words to code point offsets of the original text.
"""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import aside, free_worker, frees, stored
from marquee.session import ship_package

WINDOW = 10
#: Characters of benchmark text that one automaton holds (its keys, then its
#: nodes, are about ``WINDOW`` times as many); more text takes more passes.
MAX_ITEM_CHARS = 1_000_000

#: A-Z to a-z; the rest of ASCII but a-z and 0-9 to a space.
_NORM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORM).split()


def window_items(items: list[tuple], window: int = WINDOW) -> dict[str, tuple[int, frozenset[str]]]:
    """``{' w1 .. wn ': (n, item ids)}`` of ``(item_id, text)`` rows. An item
    without words has no window; a null id marks words but names no item."""
    found: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        w = normal_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            own = found.setdefault(b" " + b" ".join(w[i:i + n]) + b" ", (n, set()))[1]
            if item is not None:
                own.add(str(item))
    return {k.decode("utf-8", "surrogatepass"): (n, frozenset(s)) for k, (n, s) in found.items()}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _scan(keys, first: bool):
    """Adds what one automaton finds to the rows' accumulating columns."""
    def run(batches):
        import ahocorasick
        free_worker()
        auto = ahocorasick.Automaton()
        for k, v in keys.value.items():
            auto.add_word(k, v)
        if len(auto):
            auto.make_automaton()
        for b in batches:
            texts = b.column("text").to_pylist()
            old_spans = [[]] * len(texts) if first else b.column("__hit_words").to_pylist()
            old_items = [[]] * len(texts) if first else b.column("__items").to_pylist()
            counts, spans, items, chars = [], [], [], []
            for t, s, i in zip(texts, old_spans, old_items):
                w = normal_words(t)
                counts.append(len(w))
                s = [(x["lo"], x["hi"]) for x in s]
                i = set(i)
                if w and len(auto):
                    line = (b" " + b" ".join(w) + b" ").decode("utf-8", "surrogatepass")
                    hits = list(auto.iter(line))
                    if hits:
                        ends = np.fromiter(accumulate((len(x.decode("utf-8", "surrogatepass")) + 1 for x in w)), np.int64, len(w))
                        for at, (n, ids) in hits:
                            hi = int(np.searchsorted(ends, at)) + 1
                            s.append((hi - n, hi))
                            i |= ids
                s = merged(s)
                spans.append([{"lo": a, "hi": c} for a, c in s])
                items.append(sorted(i))
                at = [m.span() for m in _WORD.finditer(t)] if s else []
                chars.append([{"lo": at[a][0], "hi": at[c - 1][1]} for a, c in s])
            pair = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            new = {"__n_words": pa.array(counts, pa.int64()), "__hit_words": pa.array(spans, pair),
                   "__hit_chars": pa.array(chars, pair), "__items": pa.array(items, pa.list_(pa.string()))}
            names = [n for n in b.schema.names if n not in new]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + list(new.values()), names=names + list(new))
    return frees(run)


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                      max_item_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """``docs`` with ``__n_words``, ``__hit_words`` (merged word ranges inside
    any occurrence of a window), ``__hit_chars`` (the same as code point
    offsets of the text) and ``__items`` (ids with an occurring window, sorted
    as strings). Null texts have no words. Input columns stay, but those four
    are replaced; rows stay as many. An empty benchmark marks nothing.

    The benchmark's size is checked: up to ``max_item_chars`` it is one
    automaton, broadcast; a larger one is dealt into parts by item, scanned
    one after another over the written result of the pass before.
    """
    spark = docs.sparkSession
    ship_package(spark)
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // max_item_chars))
    dealt = items.withColumn("__part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    spans = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
    own = {"__n_words": T.LongType(), "__hit_words": spans, "__hit_chars": spans, "__items": T.ArrayType(T.StringType())}
    out = docs.drop(*own).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*out.schema.fields, *[T.StructField(n, k) for n, k in own.items()]])
    for p in range(parts):
        rows = [(r[0], r[1]) for r in dealt.where(F.col("__part") == p).select("item_id", "text").collect()]
        keys = spark.sparkContext.broadcast(window_items(rows, window))
        out = out.mapInArrow(_scan(keys, p == 0), schema)
        if p + 1 < parts:
            out = stored(out, "decontaminate")
    return out


def n_hit(marked: DataFrame):
    return F.aggregate("__hit_words", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark."""
    rows, back = aside(docs, "text")
    return back(mark_contaminated(rows, benchmark, window).where(F.size("__hit_words") == 0))


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
