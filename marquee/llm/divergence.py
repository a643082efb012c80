"""Source divergence audit by hash-consed segment trees over term ids.

A language's kept terms are dealt into buckets of bounded size; in its bucket a
term's id is its rank by total count, so that rare terms, which most sources
lack, lie side by side. In a bucket each source has a segment tree whose leaves
are its counts. The trees of all sources share their nodes: two subtrees with
the same counts are one node, so equal stretches (absent terms above all) exist
once. Two trees are read together from their roots; the node pairs that meet at
a level are reduced to the distinct ones with how often they meet, so an equal
pair is opened once and, at the leaves, priced once. Nothing is rounded: prices
are integers, and sums over buckets are the sums over all terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import frees, steps, stored
from marquee.session import ship_package

#: Documents of its language that a kept term is in; scale of a share; terms
#: a group's report has.
LEAST_DOCS, SCALE, TOP = 10, 10 ** 9, 10
#: Terms of a bucket and sources of a block, on average.
BUCKET_TERMS, BLOCK_SOURCES = 2048, 128
#: Parts that a language's terms are dealt into for a join by language.
SALTS = 64

# Bytes of a term: ASCII letters in lower case, and all that is not ASCII.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@frees
def _count(batches):
    """Per step of texts: occurrences and documents of each group's terms."""
    for b in batches:
        langs, sources = b.column("lang").to_pylist(), b.column("source").to_pylist()
        texts = b.column("text").to_pylist()
        for lo, hi in steps(texts):
            from collections import Counter, defaultdict
            n, docs = defaultdict(Counter), defaultdict(Counter)
            for i in range(lo, hi):
                words = texts[i].encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()
                n[langs[i], sources[i]].update(words)
                docs[langs[i], sources[i]].update(set(words))
            for (lang, source), own in n.items():
                if own:
                    seen = docs[lang, source]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()),
                         pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64()),
                         pa.array([seen[w] for w in own], pa.int64())], names=["lang", "source", "term", "n", "docs"])


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exactly."""
    if len(counts) and int(counts.max()) + 2 > (1 << 63) // SCALE - 1:
        return np.array([1 + SCALE * (int(c) + 2) // (total + 2 * terms) for c in counts], np.int64)
    return 1 + SCALE * (counts + 2) // (total + 2 * terms)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / (p + q)); shares are at most SCALE + 1."""
    return (p - q) ** 2 // (p + q)


def hash_consed(leaves: np.ndarray):
    """``(roots, children)`` of the segment trees of the rows of ``leaves``
    (node numbers, a power of two of them): equal subtrees are one node.
    ``children`` are the left and right nodes of each level, highest first."""
    levels = []
    at = leaves
    while at.shape[1] > 1:
        wide = np.int64(at.max()) + 1
        own, number = np.unique(at[:, 0::2] * wide + at[:, 1::2], return_inverse=True)
        levels.append((own // wide, own % wide))
        at = number.reshape(len(at), -1)
    return at[:, 0], levels[::-1]


def met_leaves(root: int, roots: np.ndarray, children):
    """Simultaneous traversal of one tree with each of others: the distinct
    ``(other, leaf, leaf of the other)`` that meet, and how often."""
    other, x, y = np.arange(len(roots)), np.full(len(roots), root, np.int64), roots.astype(np.int64)
    times = np.ones(len(roots), np.int64)
    for left, right in children:
        other, times = np.concatenate([other, other]), np.concatenate([times, times])
        x, y = np.concatenate([left[x], right[x]]), np.concatenate([left[y], right[y]])
        wide = np.int64(max(x.max(), y.max())) + 1
        key = (other * wide + x) * wide + y
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        times = np.add.reduceat(times[order], first)
        key = key[first]
        other, x, y = key // (wide * wide), key // wide % wide, key % wide
    return other, x, y, times


_PRICED = "lang string, part string, source string, item string, value long"


def _codes(column):
    coded = pc.dictionary_encode(column.combine_chunks())
    return np.asarray(coded.indices.fill_null(-1)), coded.dictionary.to_pylist()


def _price(key, t):
    """Prices of the pairs of sources of two blocks in one bucket of terms, and
    (once, where the blocks are the same) each source's best terms there."""
    lang, low, high = key[0].as_py(), key[2].as_py(), key[3].as_py()
    source, names = _codes(t.column("source"))
    term, terms = _codes(t.column("term"))
    n, total, own_n, block, in_bucket = (
        pc.fill_null(t.column(c), 0).to_numpy() for c in ("n", "total", "source_n", "block", "in_bucket"))
    head = term < 0
    every, lang_n = int(t.column("terms")[0].as_py()), int(t.column("lang_n")[0].as_py())
    size, of = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    size[source[head]], of[source[head]] = own_n[head], block[head]

    # Ids of the bucket's terms, and the sources' counts by id.
    in_all = np.zeros(len(terms), np.int64)
    in_all[term[~head]] = total[~head]
    said = [x.encode() for x in terms]
    ranked = sorted(range(len(terms)), key=lambda i: (-in_all[i], said[i]))
    place = np.empty(len(terms), np.int64)
    place[ranked] = np.arange(len(terms))
    # Terms that no source here has come last.
    here = int(in_bucket.max())
    width = 1 << max(0, here - 1).bit_length()
    counts = np.zeros((len(names), width), np.int64)
    counts[source[~head], place[term[~head]]] = n[~head]
    values, leaf = np.unique(counts, return_inverse=True)
    leaf = leaf.reshape(counts.shape).astype(np.int64)
    nothing = len(values)  # no term there: costs nothing
    leaf[:, here:] = nothing
    out: list[tuple] = []

    roots, children = hash_consed(leaf)
    share = np.array([np.r_[shares(values, s, every), 1] if every else np.ones(nothing + 1, np.int64) for s in size])
    mine = sorted(np.flatnonzero(of == low), key=lambda s: names[s].encode())
    for at, a in enumerate(mine):
        others = np.array(mine[at + 1:] if low == high else np.flatnonzero(of == high), np.int64)
        if not len(others):
            continue
        other, x, y, times = met_leaves(roots[a], roots[others], children)
        cost = np.zeros(len(others), np.int64)
        np.add.at(cost, other, np.where(x == nothing, 0, price(share[a][x], share[others[other], y]) * times))
        out += [(lang, "pair", names[a], names[b], int(c)) for b, c in zip(others, cost)]
    if low == high and len(terms):
        usual = shares(in_all[ranked], lang_n, every)
        spelled = np.empty(len(terms), np.int64)
        spelled[sorted(range(len(terms)), key=lambda i: said[ranked[i]])] = np.arange(len(terms))
        for a in mine:
            ids = np.flatnonzero(counts[a, :len(terms)])
            p, q = share[a][leaf[a, ids]], usual[ids]
            ids, p, q = ids[p > q], p[p > q], q[p > q]
            f = price(p, q)
            best = np.lexsort((spelled[ids], -f))[:TOP]
            out += [(lang, "term", names[a], terms[ranked[ids[k]]], int(f[k])) for k in best]
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)],
                    names=["lang", "part", "source", "item", "value"])


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs(lang, source,
    text)``; null in these counts as ''.

    Terms are runs of ASCII letters (lower-cased) and non-ASCII characters; a
    language keeps those in ``least_docs`` of its documents. Part ``pair``: a
    group against each other source of its language, the sum of ``price`` over
    all kept terms (0 without any). Part ``term``: the ``TOP`` kept terms that
    a group uses more than its language does, by their price. Ranks are by value,
    then item. Repeated rows count each; an empty table gives an empty result;
    other columns are not read.
    """
    ship_package(docs.sparkSession)

    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    counted = (rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
               .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    # A term's window holds one row per source; one of them stands for the term.
    term = Window.partitionBy("lang", "term")
    kept = stored(counted.withColumn("total", F.sum("n").over(term)).withColumn("in_docs", F.sum("docs").over(term))
                  .withColumn("first", F.min("source").over(term) == F.col("source"))
                  .where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "total", "first"), "kept-terms")
    groups = rows.select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    vocab = kept.where("first").groupBy("lang").agg(F.count("*").alias("terms"))
    groups = groups.join(own, ["lang", "source"], "left").join(vocab, "lang", "left").select(
        "lang", "source", F.coalesce("source_n", F.lit(0)).alias("source_n"), F.coalesce("terms", F.lit(0)).alias("terms"))
    langs = groups.groupBy("lang", "terms").agg(F.sum("source_n").alias("lang_n"), F.count("*").alias("sources")).select(
        "lang", "lang_n", F.greatest(F.lit(1), F.ceil(F.col("terms") / BUCKET_TERMS)).cast("int").alias("buckets"),
        F.ceil(F.col("sources") / BLOCK_SOURCES).cast("int").alias("blocks"))
    groups = groups.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    groups = stored(groups, "groups")
    none = F.lit(None).cast("long")
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")
    # Salted: one language may have most of the terms.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    dealt = (kept.where("first").select("lang", "term", F.pmod(F.xxhash64(F.lit(3), "term"), F.lit(SALTS)).cast("int").alias("salt"))
             .join(langs.select("lang", "buckets", salts), ["lang", "salt"])
             .groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("in_bucket")))
    heads = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), none.alias("n"), none.alias("total"),
                          "source_n", "terms", "lang_n", "block", "blocks",
                          F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    # Sources of two blocks may both lack terms of the bucket: heads say how many it has.
    heads = heads.join(dealt, ["lang", "bucket"], "left").withColumn("in_bucket", F.coalesce("in_bucket", F.lit(0)))
    counts = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "total", "source_n", "terms", "lang_n", "block", "blocks",
        bucket.alias("bucket"), none.alias("in_bucket"))
    met = (heads.unionByName(counts).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
           .drop("blocks", "other"))
    priced = stored(met.groupBy("lang", "bucket", "low", "high").applyInArrow(_price, _PRICED), "priced")

    pairs = (priced.where("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value")))
    pairs = pairs.unionByName(pairs.select("lang", "part", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    terms = priced.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)
    return pairs.unionByName(terms.select(pairs.columns)).select("lang", "source", "part", "item", "value", "rank")
