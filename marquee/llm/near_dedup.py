"""MinHash near-duplicate groups by a signature-coordinate inverted join.

1. Every document gets its set of distinct word shingles (hashed to 64 bits),
   a digest of the set (equal sets form one class) and ``k`` MinHash values.
2. Classes are posted under every coordinate-value pair. A pair of documents
   whose similarity reaches the threshold agrees on at least ``t`` of the
   ``k`` values (``t`` lies ``z`` standard deviations below the mean, so a
   pair exactly at the threshold is missed about once in a million).
3. Prefix: a class that shares fewer than ``t`` values with anyone is out.
   The others order their shared values rarest first; two classes agreeing on
   ``t`` values must meet under one of their first ``m - t + 1``.
4. Skip merging: a class's ``t - 1`` longest lists are skipped, and the
   remaining ones are not merged pair by pair. Each list is linked to its
   smallest member (a star, linear in the list), and the connected components
   of the stars are the clusters: every pair with enough collisions lies
   inside one cluster.
5. A cluster is cut into blocks of bounded size, each a task group. It counts
   the collisions of its classes over all ``k`` coordinates, those of the
   skipped lists included, retains the pairs with ``t`` or more, and confirms
   these on the full sets by an incidence product. The group returns a
   spanning forest of the confirmed links, never its pairs.
6. The cluster's hub, the class that shares most postings, is in every block,
   so copies of one text hang together after this one linear pass. What is
   left of a cluster, the classes outside its largest component so far, is cut
   into blocks of its own, and each of these meets every block of the cluster.
   Two classes of the largest component are never compared again: another
   link between them changes no component. Components of all forests are the
   near-duplicate groups.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import (aside, connected_components, free_worker, frees,
                                gram_hashes, hash_words, mix, steps, stored)

#: MinHash coordinates, and standard deviations below the mean at which the
#: match threshold lies.
K, Z = 64, 5.0
#: Bounds of one block of a cluster: documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 400_000
#: Shingle columns of one incidence product.
COLUMNS = 4096


def match_threshold(similarity: float, k: int = K, z: float = Z) -> int:
    return max(1, math.floor(k * similarity - z * math.sqrt(k * similarity * (1 - similarity))))


def shingle_sets(texts: list[str], n: int):
    """The sorted distinct shingle hashes of each text: lower-cased A-Z,
    words split at ASCII white space, ``n`` words each; a text of fewer words
    has its whole sequence as its one shingle, one without words has none."""
    for lo, hi in steps(texts):
        words: list[bytes] = []
        ends = []
        for t in texts[lo:hi]:
            words.extend(t.encode("utf-8", "surrogatepass").lower().split())
            ends.append(len(words))
        h = hash_words(words)
        del words
        at = 0
        for end in ends:
            own = h[at:end]
            at = end
            yield np.unique(gram_hashes(own, min(n, len(own)))) if len(own) else own


def _signer(k: int):
    """The ``k`` coordinate-value keys of a non-empty shingle set."""
    rng = np.random.RandomState(20_011)
    mul = rng.randint(0, 2**63 - 1, k, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.randint(0, 2**63 - 1, k, dtype=np.int64).astype(np.uint64)
    salt = mix(np.arange(1, k + 1, dtype=np.uint64))

    def sign(s: np.ndarray) -> np.ndarray:
        low = np.full(k, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 8192):
            part = s[i:i + 8192]
            np.minimum(low, (mul[:, None] * part + add[:, None]).min(axis=1), out=low)
        return mix(low ^ salt).view(np.int64)
    return sign


def _profile(n: int, k: int):
    sign = _signer(k)

    def run(batches):
        free_worker()
        for b in batches:
            sizes, digests, keys = [], [], []
            for s in shingle_sets([t or "" for t in b.column("text").to_pylist()], n):
                sizes.append(len(s))
                if not len(s):
                    digests.append(None)
                    keys.append(None)
                    continue
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(sign(s))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(sizes, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "cls", "keys"])
    return frees(run)


def _sets(n: int, k: int):
    sign = _signer(k)

    def run(batches):
        free_worker()
        for b in batches:
            rows = b.to_pydict()
            keep, sets, keys = [], [], []
            for i, s in enumerate(shingle_sets([t or "" for t in rows["text"]], n)):
                if len(s) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == rows["cls"][i]:
                    keep.append(i)
                    sets.append(s.view(np.int64))
                    keys.append(sign(s))
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows["cls"][i] for i in keep], pa.binary()),
                 pa.array([rows["cluster"][i] for i in keep], pa.int64()),
                 pa.array([rows["blocks"][i] for i in keep], pa.int64()),
                 pa.array([rows["is_hub"][i] for i in keep], pa.bool_()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))],
                names=["cls", "cluster", "blocks", "is_hub", "keys", "shingles"])
    return frees(run)


def _roots(adj: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each row of a symmetric boolean matrix."""
    lab = np.arange(len(adj))
    while True:
        new = np.where(adj, lab[None, :], len(adj)).min(axis=1)
        new = np.minimum(new, lab)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def collisions(keys: np.ndarray) -> np.ndarray:
    """On how many coordinates each two rows of ``keys`` agree."""
    out = np.zeros((len(keys), len(keys)), np.uint16)
    for column in keys.T:
        out += column[:, None] == column[None, :]
    return out


def _lists(column):
    """Values and offsets of a list column of one group."""
    lists = column.combine_chunks()
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]], ends - ends[0]


def _link(percent: int, k: int, least: int):
    def run(key, t):
        i, j = key[1].as_py(), key[2].as_py()
        cls = t.column("cls").to_pylist()
        mine = t.column("block").to_numpy()
        adj = collisions(_lists(t.column("keys"))[0].reshape(len(cls), k)) >= least
        if i != j:
            adj &= (mine[:, None] != mine[None, :]) | np.eye(len(cls), dtype=bool)
        flat, ends = _lists(t.column("shingles"))
        size = np.diff(ends)
        owner = np.repeat(np.arange(len(cls)), size)
        # Only classes with a retained pair are read further.
        some = (adj.sum(axis=1) > 1)[owner]
        flat, owner = flat[some], owner[some]
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        first = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.empty(0, bool)
        column = np.cumsum(first) - 1
        often = np.bincount(column, minlength=1) > 1
        keep = often[column] if len(flat) else first
        owner = owner[keep]
        column = (np.cumsum(often) - 1)[column[keep]] if len(owner) else column[keep]
        n = len(cls)
        inter = np.zeros((n, n), np.float32)
        total = int(column[-1]) + 1 if len(column) else 0
        cuts = np.searchsorted(column, np.arange(0, total + COLUMNS, COLUMNS))
        for c in range(len(cuts) - 1):
            lo, hi = cuts[c], cuts[c + 1]
            if lo == hi:
                continue
            m = np.zeros((n, min(COLUMNS, total - c * COLUMNS)), np.float32)
            m[owner[lo:hi], column[lo:hi] - c * COLUMNS] = 1.0
            inter += m @ m.T
        both = np.rint(inter).astype(np.int64)
        adj &= 100 * both >= percent * (size[:, None] + size[None, :] - both)
        adj |= np.eye(n, dtype=bool)
        root = _roots(adj)
        moved = np.flatnonzero(root != np.arange(n))
        return pa.table({"cluster": pa.array([key[0].as_py()] * len(moved), pa.int64()),
                         "a": pa.array([cls[x] for x in moved], pa.binary()),
                         "b": pa.array([cls[root[x]] for x in moved], pa.binary())})
    return run


def _blocks():
    """Blocks that the classes of a group need."""
    return F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES),
                      F.ceil(F.count("*") / BLOCK_DOCS)).cast("long")


def _left_over(member: DataFrame, links: DataFrame) -> DataFrame:
    """``cls, rest, n_rest, n_main`` of the classes of every cluster that is
    not yet one component: whether a class is outside the cluster's largest
    component, and the blocks of either side."""
    large = member.where("blocks > 1").select("cls", "cluster", "n_shingles")
    open_links = links.join(large.select("cluster").distinct(), "cluster", "left_semi")
    label = connected_components(open_links.select("a", "b"))
    label = large.join(label.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn(
        "label", F.coalesce("root", "cls")).drop("root")
    main = (label.groupBy("cluster", "label").agg(F.sum("n_shingles").alias("n"))
            .groupBy("cluster").agg(F.max(F.struct("n", "label"))["label"].alias("main")))
    # Written: with nothing grouped behind it, Spark may split this join at a hot cluster.
    label = stored(label.join(main, "cluster").select(
        "cls", "cluster", "n_shingles", (F.col("label") != F.col("main")).alias("rest")), "rest")
    n = label.groupBy("cluster", "rest").agg(_blocks().alias("n")).groupBy("cluster").agg(
        F.sum(F.when(F.col("rest"), F.col("n")).otherwise(0)).alias("n_rest"),
        F.sum(F.when(F.col("rest"), F.lit(0)).otherwise(F.col("n"))).alias("n_main"))
    return label.join(n.where("n_rest > 0"), "cluster").select("cls", "rest", "n_rest", "n_main")


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, k: int = K,
                    z: float = Z) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, text_hash``
    (xxhash64 of the text), ``n_shingles, component_id, kept`` (doc_id is the
    component's) and ``stays`` (the one text of its component that stays).

    Documents are linked when 100 * |A and B| >= percent * |A or B| over their
    sets of ``words``-word shingles; ``component_id`` is the smallest doc_id
    reachable. Null or wordless texts have an empty set and are linked with
    nothing. Repeated rows fall into one class. A null doc_id is linked like
    any other, is never the smallest, and is ``kept`` only when its whole
    component has no doc_id. Other columns are not read. An empty table gives
    an empty result.
    """
    t = match_threshold(percent / 100, k, z)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = stored(
        base.withColumn("text_hash", F.xxhash64("text")).select("doc_id", "text_hash", "text")
        .mapInArrow(_profile(words, k), "doc_id long, text_hash long, n_shingles long, cls binary, keys array<long>"),
        "profiles")
    full = profile.where("cls IS NOT NULL")

    # Postings, and how often each coordinate-value pair occurs.
    posts = full.select(F.xxhash64("cls").alias("node"), F.explode("keys").alias("key"))
    freq = (posts.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"),
                                     F.max("node").alias("hi"))
            .where("lo <> hi").select("key", "n"))
    shared = posts.join(freq, "key")
    prefix = (shared.groupBy("node").agg(F.collect_set(F.struct("n", "key")).alias("own"))
              .where(F.size("own") >= t)
              .select("node", F.aggregate("own", F.lit(0).cast("long"), lambda w, p: w + p["n"]).alias("weight"),
                      F.explode(F.slice(F.sort_array("own"), F.lit(1), F.size("own") - (t - 1))).alias("p"))
              .select("node", "weight", F.col("p.key").alias("key")))
    prefix = stored(prefix, "prefix")
    star = prefix.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("far")) \
        .where("pivot <> far").select("key", "pivot")
    clusters = connected_components(
        prefix.join(star, "key").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    clusters = clusters.select("node", F.col("root").alias("cluster")).join(
        prefix.groupBy("node").agg(F.max("weight").alias("weight")), "node")

    # One text per class of a cluster, cut into blocks of bounded size.
    first = full.groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("f"),
                                    F.min("n_shingles").alias("n_shingles"))
    member = first.withColumn("node", F.xxhash64("cls")).join(clusters, "node").select(
        "cls", "cluster", "weight", "n_shingles", "f.doc_id", "f.text_hash")
    member = stored(member, "members")
    sizes = member.groupBy("cluster").agg(_blocks().alias("blocks"), F.max(F.struct("weight", "cls"))["cls"].alias("hub"))
    member = member.join(sizes, "cluster").select(
        "cls", "cluster", "blocks", "n_shingles", (F.col("cls") == F.col("hub")).alias("is_hub"), "doc_id", "text_hash")
    chosen = member.select(F.col("doc_id").alias("c_doc"), F.col("text_hash").alias("c_hash"), "cls", "cluster",
                           "blocks", "is_hub")
    sets = stored(
        base.withColumn("text_hash", F.xxhash64("text"))
        .join(chosen, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("text_hash") == F.col("c_hash")))
        .select("text", "cls", "cluster", "blocks", "is_hub")
        # Equal rows all met the class: one of them, reduced before the shuffle.
        .dropDuplicates(["cls"])
        .mapInArrow(_sets(words, k), "cls binary, cluster long, blocks long, is_hub boolean, "
                                     "keys array<long>, shingles array<long>"), "sets", 16)
    zero = F.lit(0).cast("long")
    link = _link(percent, k, t)
    forest = "cluster long, a binary, b binary"
    own = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    links = stored(
        sets.withColumn("block", F.explode(F.when(F.col("is_hub"), F.sequence(zero, F.col("blocks") - 1))
                                           .otherwise(F.array(own))))
        .select("cluster", F.col("block").alias("i"), F.col("block").alias("j"), "block", "cls", "keys", "shingles")
        .groupBy("cluster", "i", "j").applyInArrow(link, forest), "links")

    # What one pass left apart, against all of its cluster.
    rest = F.col("rest")
    block = F.when(rest, F.pmod(F.xxhash64("cls"), F.col("n_rest"))).otherwise(
        F.col("n_rest") + F.pmod(F.xxhash64("cls"), F.col("n_main")))
    last = F.when(rest, F.col("n_rest") + F.col("n_main")).otherwise(F.col("n_rest")) - 1
    more = (sets.drop("blocks", "is_hub").join(_left_over(member, links), "cls").withColumn("block", block)
            .withColumn("other", F.explode(F.sequence(zero, last)))
            .select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                    "block", "cls", "keys", "shingles")
            .groupBy("cluster", "i", "j").applyInArrow(link, forest))
    component = connected_components(links.unionByName(more).select("a", "b"))

    # Back to documents.
    labelled = (profile.select("doc_id", "text_hash", "n_shingles", "cls")
                .join(component.select(F.col("node").alias("cls"), "root"), "cls", "left")
                .withColumn("root", F.coalesce("root", "cls")))
    label = labelled.where("root IS NOT NULL").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least"))
    alone = F.col("root").isNull()
    return (labelled.join(label, "root", "left")
            .withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")))
            .select("doc_id", "text_hash", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
                    (alone | (F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
                              & (F.col("text_hash") == F.col("least.text_hash")))).alias("stays")))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one per near-duplicate group stays (the
    one with the smallest doc_id; rows without words all stay, repeated rows
    of one doc_id and text stay once)."""
    groups = near_duplicates(docs, words, percent)
    stay = groups.where("stays").select(F.col("doc_id").alias("k_doc"), F.col("text_hash").alias("k_hash"))
    one = stay.distinct()
    rows, back = aside(docs, "doc_id", "text")
    out = rows.withColumn("own_hash", F.xxhash64(F.col("text").cast("string")))
    out = out.join(one, F.col("doc_id").cast("long").eqNullSafe(F.col("k_doc"))
                   & (F.col("own_hash") == F.col("k_hash")), "left_semi")
    return back(out.dropDuplicates(["doc_id", "own_hash"]))
