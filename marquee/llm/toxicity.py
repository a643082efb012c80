"""Toxicity by FTRL-proximal logistic regression over hashed features.

Features are hashed to 2^22 coordinates and count once per text: words, their
stems (the first 4, 5 and 6 bytes, as languages that inflect need), word pairs
and skip pairs (one word between). FTRL-proximal keeps a learning rate per
coordinate and drives most weights to exactly zero by its L1 term, so what is
broadcast for scoring are the few that are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import aside, free_worker, frees, gram_hashes, hash_words, mix, steps
from marquee.session import ship_package

BITS = 22
ALPHA, BETA, L1, L2 = 0.5, 1.0, 4.0, 0.5
EPOCHS = 3
#: Labelled texts that the model is fitted on at most (chosen by a hash).
FIT_ROWS = 16_000
THRESHOLD = 0.3

#: ASCII but letters and digits to a space, A-Z to a-z.
_NORM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))
_STEMS = [(1 << 32) - 1, (1 << 40) - 1, (1 << 48) - 1]


def feature_slots(texts: list[str | None]):
    """Per text the coordinates of all its features (not distinct)."""
    shift = np.uint64(64 - BITS)
    texts = [t or "" for t in texts]
    for lo, hi in steps(texts):
        words: list[bytes] = []
        ends = []
        for t in texts[lo:hi]:
            words += t.encode("utf-8", "surrogatepass").translate(_NORM).split()
            ends.append(len(words))
        h = hash_words(words)
        eight = np.array(words, dtype="S8").view("<u8") if words else h
        del words
        stems = [mix(np.uint64(k + 1) + mix(eight & np.uint64(m))) >> shift for k, m in enumerate(_STEMS)]
        single = mix(h) >> shift
        at = 0
        for end in ends:
            own = h[at:end]
            yield np.concatenate([single[at:end], *[s[at:end] for s in stems],
                                  gram_hashes(own, 2) >> shift, gram_hashes(own, 2, (0, 2)) >> shift]).astype(np.int32)
            at = end


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, alpha: float = ALPHA,
         beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[float, np.ndarray]:
    """Bias and weights (2^BITS) of FTRL-proximal over presence features."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i):
        # The bias (the last slot) is not penalised.
        penalty = np.where(i == size, 0.0, l1)
        w = -(z[i] - np.sign(z[i]) * penalty) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= penalty, 0.0, w)
    for _ in range(epochs):
        for row, y in zip(rows, labels):
            i = np.append(row, size)
            w = weights(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    every = weights(np.arange(size + 1))
    return float(every[-1]), every[:-1]


@frees
def _features(batches):
    free_worker()
    for b in batches:
        kind = pa.list_(pa.int32())
        rows = [np.unique(x) for x in feature_slots(b.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("place"), b.column("label"), pa.array(rows, kind)],
                                         names=["place", "label", "slots"])


@frees
def _fit(batches):
    """One task: the sample's rows, in the order of their hash."""
    got = [(p, y, np.asarray(x.values, np.int32)) for b in batches
           for p, y, x in zip(b.column("place").to_pylist(), b.column("label").to_pylist(), b.column("slots"))]
    if not got:
        return
    got.sort(key=lambda r: r[0])
    bias, w = ftrl([x for _, _, x in got], np.array([y for _, y, _ in got], float))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[bias, w[at]], pa.float64())],
                                     names=["slot", "weight"])


def held_out(doc_id):
    """A quarter of the ids, by their checksum, that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int = FIT_ROWS) -> DataFrame:
    """``place, label, text``: at most ``limit`` rows, one of each labelled
    document of ``docs`` outside the held-out quarter, by the hash of their id
    (a bounded sample). Null labels and ids are skipped; an id with several
    labels has its largest, one with several texts the greatest."""
    some = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy(F.col("doc_id").cast("long").alias("l_doc")).agg(F.max(label).cast("int").alias("label")))
    # Ids alone: labels of documents that are not here take no place.
    here = docs.select(F.col("doc_id").cast("long").alias("h_doc")).distinct()
    some = (some.join(here, F.col("l_doc") == F.col("h_doc"), "left_semi")
            .withColumn("place", F.xxhash64(F.lit(5), "l_doc")).orderBy("place", "l_doc").limit(limit))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # ``limit`` narrow rows: a bounded broadcast. Repeated ids are reduced
    # before the shuffle, so a task sends one text of each at most.
    return (text.join(F.broadcast(some), F.col("doc_id") == F.col("l_doc"))
            .groupBy("l_doc", "place", "label").agg(F.max("text").alias("text")).select("place", "label", "text"))


def _fitted(docs: DataFrame, labels: DataFrame, label: str, limit: int):
    """``fit_toxicity``'s model, or None without any labelled row."""
    ship_package(docs.sparkSession)
    sample = fit_rows(docs, labels, label, limit)
    fitted = (sample.mapInArrow(_features, "place long, label int, slots array<int>").repartition(1)
              .mapInArrow(_fit, "slot int, weight double"))
    rows = fitted.toArrow()
    if not rows.num_rows:
        return None
    slot, weight = rows.column("slot").to_numpy(), rows.column("weight").to_numpy()
    bias = weight[slot < 0].sum()
    return float(bias), slot[slot >= 0].astype(np.int32), weight[slot >= 0].astype(np.float32)


#: No knowledge: every score is one half.
_NO_MODEL = (0.0, np.empty(0, np.int32), np.empty(0, np.float32))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = FIT_ROWS):
    """``(bias, slots, weights)``: the model's non-zero weights. Without any
    labelled row the bias is that of no knowledge, 0."""
    return _fitted(docs, labels, label, limit) or _NO_MODEL


def _score(model):
    def run(batches):
        free_worker()
        bias, slots, weights = model.value
        table = np.zeros(1 << BITS, np.float32)
        table[slots] = weights
        for b in batches:
            out = []
            for x in feature_slots(b.column("text").to_pylist()):
                x = x[table[x] != 0]
                total = bias + float(table[np.unique(x)].sum(dtype=np.float64))
                out.append(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "__score"])
    return frees(run)


def _scored(docs: DataFrame, model) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(_score(model), T.StructType([*rows.schema.fields, T.StructField("__score", T.DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """``docs`` with ``__score`` (0 to 1, higher: likelier toxic). Only texts
    are inputs of a score; null counts as empty and scores by the bias.
    Repeated rows score alike; an empty table gives an empty result; where no
    label could be learned every score is one half. A column ``__score`` of
    ``docs`` is replaced."""
    docs = docs.drop("__score")
    return _scored(docs, fit_toxicity(docs, labels, "toxic", limit))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; all rows where no
    label could be learned (``labels`` has none of these documents)."""
    model = _fitted(docs, labels, "toxic", FIT_ROWS)
    if model is None:
        return docs
    rows, back = aside(docs, "text")
    return back(_scored(rows, model).where(F.col("__score") < threshold))
