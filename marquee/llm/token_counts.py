"""Token counts from pre-token frequencies, without token ids.

Every document becomes its pre-token frequencies. Frequent pre-tokens (the
head, a size-bounded broadcast, each counted once) meet their counts where they
stand. The others are dealt and sorted by pre-token: each distinct one is one
run of rows, counted once, and its count meets the frequencies of the run, as in
a merge join whose other side is the table of distinct pre-tokens. Sums per
document follow. No ids leave a task.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import frees, steps
from marquee.llm.tokens import encoder
from marquee.session import ship_package

#: The head: pre-tokens at most, and their characters at most. It only says
#: where a pre-token is counted, never whether, so it is taken from a bounded
#: sample of about HEAD_DOCS documents.
HEAD, HEAD_CHARS, HEAD_DOCS = 262_144, 8 << 20, 20_000
#: A longer pre-token is counted where it stands: as a key it would carry its
#: text through the shuffle.
KEY_CHARS = 512


def _pieces(path: str):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in steps(texts):
                c: Counter = Counter()
                for t in texts[lo:hi]:
                    c.update(enc.parts(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["piece", "n"])
    return frees(run)


def _counts(path: str):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            pieces = b.column("piece").to_pylist()
            known = enc.lookup(set(pieces))
            size = [len(known[p]) // enc.width for p in pieces]
            yield pa.RecordBatch.from_arrays([b.column("piece"), pa.array(size, pa.int64())], names=["piece", "size"])
    return frees(run)


def _frequencies(path: str, head):
    """One row per document (its bytes and the tokens of its head pre-tokens,
    under a key of its own) and one per other pre-token of it."""
    def run(batches):
        enc, known = encoder(path), head.value
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        names = ["doc_id", "text_hash", "n_bytes", "known", "piece", "n"]
        for b in batches:
            ids_of, hashes = b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist()
            texts = b.column("text").to_pylist()
            for lo, hi in steps(texts):
                cols: list[list] = [[], [], [], [], [], []]
                for i in range(lo, hi):
                    parts = enc.parts(texts[i])
                    sizes = list(map(known.get, parts))
                    rest = Counter(p for p, s in zip(parts, sizes) if s is None)
                    long = {p: m for p, m in rest.items() if len(p) > KEY_CHARS}
                    here = sum(filter(None, sizes))
                    if long:
                        rest = {p: m for p, m in rest.items() if p not in long}
                        here += sum(m * len(ids) for m, ids in zip(long.values(), enc.resolve(list(long)))) // enc.width
                    m = 1 + len(rest)
                    cols[0] += [ids_of[i]] * m
                    cols[1] += [hashes[i]] * m
                    cols[2] += [len(texts[i].encode())] + [None] * (m - 1)
                    cols[3] += [here] + [0] * (m - 1)
                    cols[4] += ["\x00%s %d" % (ids_of[i], hashes[i]), *rest]
                    cols[5] += [0, *rest.values()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
    return frees(run)


def _run_counts(path: str):
    """Tokens of each row of a partition sorted by pre-token: the count of its
    pre-token, made once at the run's first row, times its frequency."""
    def run(batches):
        enc = encoder(path)
        last, last_size = None, 0
        for b in batches:
            n, pieces = b.column("n").to_pylist(), b.column("piece").to_pylist()
            new = list(dict.fromkeys(p for p, m in zip(pieces, n) if m and p != last))
            size = dict(zip(new, (len(x) // enc.width for x in enc.resolve(new))))
            if last is not None:
                size[last] = last_size
            got = [k if not m else m * size[p] for p, m, k in zip(pieces, n, b.column("known").to_pylist())]
            if new:
                last, last_size = new[-1], size[new[-1]]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), b.column("n_bytes"), pa.array(got, pa.int64())],
                names=["doc_id", "text_hash", "n_bytes", "tokens"])
    return frees(run)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, head_docs: int = HEAD_DOCS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_bytes`` (UTF-8),
    ``n_tokens`` as the tokenizer file ``path`` gives them (no special tokens
    added; those inside texts as the library's default), ``over_limit``. Null
    text counts as empty; repeated rows each get a row; an empty table gives
    none; other columns are not read."""
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("text_hash", F.xxhash64("text"))
    every = max(1, base.count() // head_docs)
    sample = base.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(every)) == 0)
    common = (sample.select("text").mapInArrow(_pieces(path), "piece string, n long")
              .groupBy("piece").agg(F.sum("n").alias("n")).where(F.length("piece") <= HEAD_CHARS // 1024)
              .orderBy(F.desc("n"), "piece").limit(HEAD).select("piece"))
    known, chars = {}, 0
    for r in common.mapInArrow(_counts(path), "piece string, size long").collect():
        chars += len(r["piece"])
        if chars <= HEAD_CHARS:
            known[r["piece"]] = r["size"]
    head = spark.sparkContext.broadcast(known)
    rows = base.mapInArrow(_frequencies(path, head),
                           "doc_id long, text_hash long, n_bytes long, known long, piece string, n long")
    tokens = rows.repartition("piece").sortWithinPartitions("piece").mapInArrow(
        _run_counts(path), "doc_id long, text_hash long, n_bytes long, tokens long")
    # A repeated row repeats all of its rows: the sums are shared by them.
    total = tokens.groupBy("doc_id", "text_hash").agg(
        F.sum("tokens").alias("tokens"), F.max("n_bytes").alias("n_bytes"), F.count("n_bytes").alias("rows"))
    total = total.withColumn("n_tokens", (F.col("tokens") / F.col("rows")).cast("long"))
    return (total.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
