"""Document quality by hierarchical empirical Bayes.

1. Evidence: a logistic regression on a few text statistics (computed with
   DataFrame functions) gives each document a probability of its own.
2. Sites: grouped sums over (host, path) and host give every site a Beta
   posterior. A path shrinks toward its host's other paths, these toward the
   global mean;
   how strongly follows from the variance between sites beyond what sampling
   explains (method of moments), so a sparse site stays near its prior.
3. A document's own evidence is taken out of its site's sums before the two
   are combined as log-odds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import stored
from marquee.llm.toxicity import FIT_ROWS, fit_rows, held_out

STATS = ("size", "variety", "line_variety", "marks", "bars", "digits", "word_length", "short")


def text_statistics(text: Column) -> list[Column]:
    """The statistics of a text (null: empty), as columns named ``__s_*``."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    words = F.filter(F.split(t, "[ \\t-\\r]+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))
    lines = F.split(t, "\n")

    def share(pattern):
        return F.regexp_count(t, F.lit(pattern)) / chars
    own = {"size": F.log1p(F.size(words).cast("double")),
           "variety": F.size(F.array_distinct(words)) / n,
           "line_variety": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
           "marks": F.sqrt(share("[#$%&*@~^<>{}\\[\\]=+\\\\]")), "bars": F.sqrt(share("[|]")),
           "digits": F.sqrt(share("[0-9]")), "word_length": chars / n / 10, "short": 1 / n}
    return [own[s].cast("double").alias(f"__s_{s}") for s in STATS]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, bias, means and scales of a ridge logistic regression (Newton
    steps). One class alone or no rows: weights 0, the smoothed log-odds."""
    if not len(x):
        return np.zeros(len(STATS)), 0.0, np.zeros(len(STATS)), np.ones(len(STATS))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if y.min() == y.max():
        return np.zeros(x.shape[1]), base, mean, scale
    a = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    w = np.zeros(a.shape[1])
    w[-1] = base
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1]), mean, scale


def fit_evidence(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS):
    """The classifier, from at most ``limit`` labelled rows' eight numbers."""
    rows = fit_rows(docs, labels, "quality", limit).select("place", "label", *text_statistics(F.col("text"))).toPandas()
    rows = rows.sort_values("place", kind="stable")
    return fit_logistic(rows[[f"__s_{s}" for s in STATS]].to_numpy(float), rows["label"].to_numpy(float))


def evidence(model) -> Column:
    w, bias, mean, scale = model
    total = F.lit(float(bias))
    for k, s in enumerate(STATS):
        v = (F.col(f"__s_{s}") - float(mean[k])) / float(scale[k])
        total = total + F.greatest(F.least(v, F.lit(8.0)), F.lit(-8.0)) * float(w[k])
    return 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))))


def strength(sites: DataFrame, mean: float, least: float = 1.0, most: float = 1000.0) -> float:
    """Pseudo-count of the prior over ``sites(n, s)``: the one whose Beta has
    the variance between sites that sampling does not explain."""
    r = sites.where("n > 0").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("ss")).first()
    if not r["k"] or r["k"] < 2 or r["n"] <= r["k"]:
        return most
    within = mean * (1 - mean)
    spread = (r["ss"] - (r["k"] - 1) * within) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    if spread <= 0:
        return most
    return float(min(most, max(least, within / spread - 1)))


def combine(rows: DataFrame, least: float = 1.0, most: float = 1000.0) -> DataFrame:
    """``rows`` with columns ``__host, __path`` (nulls are a site of their own),
    ``__evidence`` (0 to 1) and ``__belief`` (the label where known, else the
    evidence), plus ``__site`` and ``__posterior``.

    Sums are partial before the shuffle; a host with a third of all rows is
    one row of the table joined back, and the rows are narrow.
    """
    paths = rows.groupBy("__host", "__path").agg(F.count("*").cast("double").alias("n"), F.sum("__belief").alias("s"))
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = float((total[1] + 1) / (total[0] + 2)) if total[0] else 0.5
    k_host = strength(hosts, mean, least, most)
    k_path = strength(paths, mean, least, most)
    sums = (paths.join(hosts.select(F.col("__host").alias("h"), F.col("n").alias("hn"), F.col("s").alias("hs")),
                       F.col("__host").eqNullSafe(F.col("h")))
            .select(F.col("__host").alias("j_host"), F.col("__path").alias("j_path"), "n", "s", "hn", "hs"))
    out = rows.join(sums, F.col("__host").eqNullSafe(F.col("j_host")) & F.col("__path").eqNullSafe(F.col("j_path")))
    # The host's other paths: a path's own rows count once, in its own sums.
    host = (k_host * mean + F.col("hs") - F.col("s")) / (k_host + F.col("hn") - F.col("n"))
    out = out.withColumn("__host_mean", host)
    site = (k_path * F.col("__host_mean") + F.col("s") - F.col("__belief")) / (k_path + F.col("n") - 1)
    logit = lambda p: F.log(p / (1 - p))
    safe = lambda p: F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    out = out.withColumn("__site", safe(site))
    odds = logit(safe(F.col("__evidence"))) + logit(F.col("__site")) - float(np.log(mean / (1 - mean)))
    return out.withColumn("__posterior", 1 / (1 + F.exp(-odds))).drop(
        "j_host", "j_path", "n", "s", "hn", "hs", "__host_mean")


def score_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, limit: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, held_out,
    evidence, site, score`` (0 to 1, higher: better). Null text counts as
    empty; labels outside the held-out quarter count in their sites, others are
    never read; without labels all evidence is one half; an empty table gives
    an empty result; columns of any other name may be there."""
    model = fit_evidence(docs, labels, limit)
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("k_doc")).agg(F.max("quality").cast("double").alias("k_label")))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("__host"),
                        path.cast("string").alias("__path"), *text_statistics(F.col("text")))
            .withColumn("__evidence", evidence(model)).select("doc_id", "__host", "__path", "__evidence"))
    rows = (rows.join(known, F.col("doc_id") == F.col("k_doc"), "left")
            .withColumn("__belief", F.coalesce("k_label", "__evidence")).drop("k_doc", "k_label"))
    # Narrow rows, read four times below: the texts are read once for them.
    rows = stored(rows, "evidence")
    return combine(rows).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__evidence").alias("evidence"),
                                F.col("__site").alias("site"), F.col("__posterior").alias("score"))
