"""Threshold-scaled document fingerprints, in DataFrame functions only.

A fingerprint keeps every distinct shingle hash below a fixed fraction of the
hash space, so its size follows the document, the fingerprint of a union is
the union of the fingerprints, and two documents of very unequal length can be
compared by containment. A text whose shingles all lie above the threshold has
an empty one; the smallest hash of every text stands in a column of its own
(null: no words), which tells such a text from one without words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import ascii_lower

#: Words of a shingle; one in FRACTION hashes is kept.
WORDS, FRACTION = 5, 4
#: Rows of one ordered bucket, and the most buckets (their lower bounds are a
#: literal of the plan; beyond it buckets grow and sort by spilling).
BUCKET_ROWS, MAX_BUCKETS, FAN = 2000, 4096, 64


def with_fingerprint(df: DataFrame, text: str, name: str, words: int = WORDS,
                     fraction: int = FRACTION) -> DataFrame:
    """``df`` with ``name``: the sorted kept hashes (array<long>) of ``text``,
    and ``{name}_least``: its smallest hash, kept or not.

    Words are split at ASCII white space after lower-casing A-Z; fewer than
    ``words`` words form one shingle; null and wordless texts give an empty
    array and no smallest hash. Each step is its own column, so no shingle is
    hashed twice.
    """
    w, h = f"__{name}_w", f"__{name}_h"
    low = -(1 << 63) + (1 << 64) // fraction
    gram = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0))),
                       lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(words)]))
    return (df.withColumn(w, F.filter(F.split(ascii_lower(F.col(text)), "[ \\t-\\r]+"), lambda x: x != ""))
            .withColumn(h, F.when(F.size(w) > 0, gram).otherwise(F.array().cast("array<bigint>")))
            .withColumn(name, F.sort_array(F.array_distinct(F.filter(h, lambda x: x < F.lit(low).cast("long")))))
            .withColumn(f"{name}_least", F.array_min(h))
            .drop(w, h))


def merge(a: Column, b: Column) -> Column:
    """The fingerprint of two texts' shingles together; its smallest hash is
    the least of theirs."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column, least_a: Column | None = None, least_b: Column | None = None) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has (two texts without
    words: 1, one: 0).

    Where ``a`` has words but no kept hash, its smallest hash decides if
    ``b``'s is not below it (alike: 1, else 0); if it is, or without the
    smallest hashes, nothing is known of ``a``: null.
    """
    share = F.size(F.array_intersect(a, b)) / F.size(a)
    if least_a is None or least_b is None:
        return F.when(F.size(a) > 0, share)
    return (F.when(F.size(a) > 0, share)
            .when(least_a.isNull() & least_b.isNull(), 1.0).when(least_a.isNull() | least_b.isNull(), 0.0)
            .when(least_a == least_b, 1.0).when(least_a < least_b, 0.0))


def resemblance(a: Column, b: Column, least_a: Column | None = None, least_b: Column | None = None) -> Column:
    """Estimated Jaccard similarity (two texts without words: 1, one: 0). Where
    neither has a kept hash the smallest hashes decide (alike: 1, else 0);
    without them nothing is known: null."""
    every = F.size(F.array_union(a, b))
    share = (F.size(a) + F.size(b) - every) / every
    if least_a is None or least_b is None:
        return F.when(every > 0, share)
    return F.when(every > 0, share).otherwise(least_a.eqNullSafe(least_b).cast("double"))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.hex(x))), ",")


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are <= doc_id (null: none): the block
    first, then the place in it."""
    if not bounds:
        return F.lit(0)
    blocks = [bounds[i:i + FAN] for i in range(0, len(bounds), FAN)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    block = F.size(F.filter(longs([b[0] for b in blocks]), lambda x: x <= doc_id))
    inner = F.size(F.filter(F.get(F.array(*[longs(b) for b in blocks]), block - 1), lambda x: x <= doc_id))
    return F.when(block <= 0, F.lit(0)).otherwise((block - 1) * FAN + inner)


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, Window]:
    """``(doc_id, text, flag, next_text)`` and the window over it: the text of
    the next row in (doc_id, text) order, nulls first, the last row's next
    being the first. Null texts count as empty.

    No window spans the table: rows go to ordered buckets (quantiles of the
    ids), the texts move once, and each bucket gets a copy of the next
    bucket's first row (flag 1) as its last.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, with_id = base.agg(F.count("*"), F.count("doc_id")).first()
    bounds: list[int] = []
    if with_id:
        k = min(MAX_BUCKETS, max(1, -(-with_id // bucket_rows)))
        q = base.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / k for i in range(k)], 20 * k + 100)).first()
        bounds = sorted({q[0], *q[1]})
    first = 0 if n > with_id else 1
    rows = base.withColumn("bucket", _bucket(F.col("doc_id"), bounds)).withColumn("flag", F.lit(0))
    ends = (rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("r"))
            .select(F.col("r.doc_id").alias("doc_id"), F.col("r.text").alias("text"),
                    F.when(F.col("bucket") <= first, F.lit(len(bounds))).otherwise(F.col("bucket") - 1).alias("bucket"),
                    F.lit(1).alias("flag")))
    w = Window.partitionBy("bucket").orderBy("flag", "doc_id", "text")
    return rows.unionByName(ends).withColumn("next_text", F.lead("text").over(w)), w


def fingerprint_edits(docs: DataFrame, words: int = WORDS, fraction: int = FRACTION) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: its fingerprint, that of its edited
    text (the last floor(n/2) code points replaced by the first as many, or
    all, of the next document) and how alike they are and the next document's.

    Null text counts as empty. Ties of doc_id go by text; rows without an id
    come first. One row is its own next. Empty table: empty result. Other
    columns are not read. ``least`` and ``edited_least`` are the smallest
    hashes; a containment that they leave open is null.
    """
    rows, w = with_next(docs)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = (rows.withColumn("n_chars", F.length("text").cast("long"))
            .withColumn("edited", F.concat(
                F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
                F.substring("next_text", F.lit(1), half))))
    rows = with_fingerprint(rows, "text", "own", words, fraction)
    rows = (rows.withColumn("next_own", F.lead("own").over(w)).withColumn("next_least", F.lead("own_least").over(w))
            .where("flag = 0"))
    rows = with_fingerprint(rows, "edited", "changed", words, fraction)
    own, changed, follows = [(F.col(f), F.col(least)) for f, least in (
        ("own", "own_least"), ("changed", "changed_least"), ("next_own", "next_least"))]

    def compare(how, other):
        return how(own[0], other[0], own[1], other[1])
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(own[0]).alias("fingerprint"), as_text(changed[0]).alias("edited_fingerprint"),
        compare(resemblance, changed).alias("near_edited"), compare(resemblance, follows).alias("near_next"),
        compare(containment, changed).alias("contained_edited"), compare(containment, follows).alias("contained_next"),
        F.lower(F.hex(own[1])).alias("least"), F.lower(F.hex(changed[1])).alias("edited_least"))
