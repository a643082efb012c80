"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import functions as F

from marquee.llm import (bpe, chat_format, decontaminate, divergence,
                         fingerprints, merkle, mixing, near_dedup, quality, secret_scan, token_counts,
                         token_files, toxicity)
from marquee.llm.common import ascii_lower, scratch_table, table

TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_minhash_near_dedup", """
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + least(3, len(w)) - 1) AS s
  FROM doc, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
both_in AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM both_in JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y
  WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT link.y, reach.r FROM reach JOIN link ON link.x = reach.doc_id),
least_of AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, component_id, doc.doc_id = component_id AS kept
FROM doc LEFT JOIN size USING (doc_id) JOIN least_of USING (doc_id)
""")
def op1(spark, sf_dir):
    """Near-duplicate groups of all documents: 3-word shingles, Jaccard 0.85."""
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@query("op2_document_fingerprints")
def op2(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op3_chat_formatting", """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
chat AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         -- a turn is written with 13 characters of control strings and one more per escaped character
         sum(13 + length(role) + length(text) + length(role) - length(translate(role, '<[|', ''))
             + length(text) - length(translate(text, '<[', ''))) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM chat
""")
def op3(spark, sf_dir):
    """All conversations and conversation -7, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    parts = rows.withColumn("parts", chat_format.text_part(F.col("text")))
    back = chat_format.read_back(chat_format.format_chats(parts))
    said = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("said").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op5_benchmark_decontamination", """
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS p
  FROM item, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
len_of AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS p
  FROM doc, len_of, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT place.doc_id, place.n, place.i, win.item_id FROM place JOIN win ON place.n = win.n AND place.p = win.p),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(k) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(doc.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(ids.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids.ids, '')) AS items_sha256,
       coalesce(words.n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
""")
def op5(spark, sf_dir):
    """Windows of all benchmark items in all documents."""
    out = decontaminate.mark_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", F.col("__n_words").alias("n_words"), decontaminate.n_hit(out).alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("__hit_words") > 0).alias("contaminated"))


@query("op6_secret_scan")
def op6(spark, sf_dir):
    """Secrets of all documents through a new ledger."""
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents"), scratch_table(spark, "ledger"))

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    return out.select("doc_id", n("assign"), n("access"), n("hex"),
                      F.sha2(secret_scan.spans_text(base).cast("binary"), 256).alias("base_sha256"),
                      secret_scan.spans_text(F.col("spans")).alias("spans"))


@query("op10_source_mixing")
def op10(spark, sf_dir):
    """The mix of all documents: what each gives."""
    out = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                      F.col("__target").alias("target"), F.col("__taken").alias("taken"))


@query("op4_toxicity")
def op4(spark, sf_dir):
    """Toxicity scores of all documents."""
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"),
                      (F.col("__score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op7_token_counts")
def op7(spark, sf_dir):
    """Token counts of all documents."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query("op8_token_files")
def op8(spark, sf_dir):
    """All documents written as token files, read back."""
    out = scratch_table(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), out)
    return token_files.read_token_files(spark, out)


@query("op9_quality")
def op9(spark, sf_dir):
    """Quality of all documents: sources are hosts, their languages paths."""
    docs = table(spark, sf_dir, "documents")
    out = quality.score_quality(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op13_merkle_manifest", """
WITH RECURSIVE spelled AS (
  SELECT doc_id, source, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
         || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
         -- crc32, bit by bit
         list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::UBIGINT)),
           lambda c, d: list_reduce(list_prepend(xor(c, d), list_transform(range(8), lambda k: 0::UBIGINT)),
                                    lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, coalesce('s' || source, '') AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
         CASE WHEN xor(crc, 4294967295::UBIGINT) % 5 = 0
              THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))
              END AS changed
  FROM spelled),
placed AS (
  SELECT row_number() OVER (ORDER BY g, doc_id NULLS FIRST, h) AS r, doc_id, g, h, changed,
         row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
  FROM leaf),
node AS (
  SELECT 0 AS lvl, g, i, n, h FROM placed
  UNION ALL
  SELECT lvl + 1, g, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY lvl, g, i // 16, n),
sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
high AS (
  SELECT 0 AS lvl, i, n, subroot AS h FROM sub
  UNION ALL
  SELECT lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, i // 16, n),
run AS (SELECT lvl, g, i // 16 AS b, string_agg(h, '' ORDER BY i) AS s FROM node WHERE n > 1 GROUP BY ALL),
high_run AS (SELECT lvl, i // 16 AS b, string_agg(h, '' ORDER BY i) AS s FROM high WHERE n > 1 GROUP BY ALL),
low_fold AS (
  SELECT r, 0 AS lvl, g, i, n, coalesce(changed, h) AS f, '' AS p FROM placed
  UNION ALL
  SELECT r, lvl + 1, g, i // 16, (n + 15) // 16, sha256(substr(s, 1, (i % 16) * 64) || f || substr(s, (i % 16) * 64 + 65)),
         p || substr(s, 1, (i % 16) * 64) || substr(s, (i % 16) * 64 + 65)
  FROM low_fold JOIN (SELECT lvl AS l2, g AS g2, b, s FROM run) ON l2 = lvl AND g2 = g AND b = i // 16 WHERE n > 1),
high_fold AS (
  SELECT r, 0 AS lvl, sub.i, sub.n, f, p FROM low_fold JOIN sub USING (g) WHERE low_fold.n = 1
  UNION ALL
  SELECT r, lvl + 1, i // 16, (n + 15) // 16, sha256(substr(s, 1, (i % 16) * 64) || f || substr(s, (i % 16) * 64 + 65)),
         p || substr(s, 1, (i % 16) * 64) || substr(s, (i % 16) * 64 + 65)
  FROM high_fold JOIN (SELECT lvl AS l2, b, s FROM high_run) ON l2 = lvl AND b = i // 16 WHERE n > 1)
SELECT doc_id, placed.h AS leaf, subroot, high.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = high.h AS verified
FROM placed JOIN sub USING (g) JOIN high_fold USING (r) CROSS JOIN high WHERE high_fold.n = 1 AND high.n = 1
""")
def op13(spark, sf_dir):
    """Manifest of all documents; a fifth of the rows is checked with a changed text."""
    docs = table(spark, sf_dir, "documents")
    low = F.when(F.col("text").isNotNull(), ascii_lower(F.col("text")))
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                     merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], low))
    out = merkle.manifest(docs, carry={"changed": changed})
    out = out.withColumn("folded_root", merkle.fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("proof"))).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op11_source_divergence", """
WITH doc AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
said AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS total FROM said GROUP BY ALL HAVING count(DISTINCT r) >= 10),
many AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM said JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (
  SELECT lang, source, coalesce(sum(n), 0) AS source_n
  FROM (SELECT DISTINCT lang, source FROM doc) LEFT JOIN own USING (lang, source) GROUP BY ALL),
share AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2) // CAST(source_n + 2 * v AS HUGEINT) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (total + 2) // CAST(lang_n + 2 * v AS HUGEINT) AS q
  FROM grp JOIN many USING (lang) JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)),
cost AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN cost ON cost.lang = a.lang AND cost.source = a.source AND cost.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM share WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM part)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
""")
def op11(spark, sf_dir):
    """Sources of all documents against each other and against their language."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query("op12_bpe_codec")
def op12(spark, sf_dir):
    """All documents encoded by the trie, and decoded again."""
    path = public_tokenizers.path(TOKENIZER)
    out = bpe.decode_ids(bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
