"""Rows with the awkward cases every operator must survive, and small
brute-force helpers."""

import random

VOC = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa",
       "été", "straße", "mañana", "x1", "y2", "z3", "lorem", "ipsum", "dolor", "sit"]


def prose(rng, n):
    return " ".join(rng.choice(VOC) + str(rng.randint(0, 60)) for _ in range(n))


def documents(seed=7):
    """(doc_id, text, lang, source, n_chars) rows: nulls, empty and very long
    texts, exact and near copies, repeated rows, ties."""
    rng = random.Random(seed)
    rows, texts = [], []
    for i in range(60):
        texts.append(prose(rng, rng.choice([1, 2, 3, 8, 30, 120])))
    base = prose(rng, 140).split(" ")
    for i in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randint(0, 10 ** 6)
        texts.append(" ".join(w))
    texts += [texts[5], texts[5], texts[60], "", "   \n\t ", None, prose(rng, 20000),
              "Ünïcode 😀 text with nbsp\x1c odd", "  leading\n\n  and  double  spaces \n ", "one"]
    for i, t in enumerate(texts):
        rows.append((i * 3, t, "en", None if i % 11 == 0 else "src%d" % (i % 4), None if t is None else len(t)))
    rows.append(rows[4])
    rows.append((None, "row without an id", "en", "src1", 17))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


#: Names that operators give their own columns while they work.
CLASHES = ("row", "hash", "idx", "n", "g_key", "path", "top", "leaf", "term", "total", "docs", "piece", "before", "data",
           "k_doc", "k_hash", "own_hash", "c_doc", "c_hash", "cluster", "blocks", "is_hub", "text_hash", "place", "label",
           "l_doc", "aside_0", "aside_7", "__hash", "__src", "__rank", "__p_src", "__blocks", "__shards", "__shard",
           "__supply", "__quota", "__q_src", "__q_shard", "__q_key", "__more", "__from", "__key", "__hi", "__copy", "__part")
#: Names of the columns that marking functions add.
ADDED = ("__score", "__n_words", "__hit_words", "__hit_chars", "__items", "__size", "__source_size", "__target",
         "__passes", "__cuts", "__taken")


def with_clashes(df):
    """Extra columns whose names operators use inside."""
    from pyspark.sql import functions as F
    own = ("node", "key", "size", "score", "start", "n_tokens", "kept", "cls", "bucket", "target", "taken")
    return df.select("*", *[F.lit("x").alias(c) for c in own + CLASHES])
