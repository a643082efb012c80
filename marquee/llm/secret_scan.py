"""Secret scans over an incremental blob ledger.

A version of a text is addressed by the SHA-256 of its content. The ledger
(Parquet in a shared folder) has one row per scanned blob and rule version,
with its findings, empty or not. A scan anti-joins the blobs at hand with the
ledger, scans only unseen ones, once per blob however many paths or versions
hold it, appends them, and joins the findings back to every path.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import ship_package

#: The base rules, leftmost and non-overlapping per kind. A
#: match that fails its least length is dropped, but its characters are used.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Rules that the method adds.
GITHUB = r"gh[pousr]_[A-Za-z0-9]{36,}"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
RULE_VERSION = "2"
BASE = ("assign", "access", "hex")
SPAN = "struct<kind:string,start:bigint,end:bigint>"

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX.replace("+", "{24,}"))  # a maximal run of 24 or more
_GITHUB, _PEM = re.compile(GITHUB), re.compile(PEM)
_HINTS = ("passw", "secret", "token", "api")


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then kind. The value
    group of ``assign`` has its letters in either case by the flag."""
    text = text or ""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "gh" in text:
        out += [("github", *m.span()) for m in _GITHUB.finditer(text)]
    if "PRIVATE KEY" in text:
        out += [("pem", *m.span()) for m in _PEM.finditer(text)]
    rank = {k: i for i, k in enumerate((*BASE, "github", "pem"))}
    return sorted(out, key=lambda s: (s[1], rank[s[0]]))


def _scan(batches):
    for b in batches:
        spans = [[{"kind": k, "start": a, "end": z} for k, a, z in find_secrets(t)] for t in b.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array(spans, kind)], names=["blob", "spans"])


def read_ledger(spark, path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scanned blobs of one rule version (none yet: empty)."""
    kinds = f"blob string, rule_version string, spans array<{SPAN}>"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], kinds)
    return (spark.read.schema(kinds).parquet(path).where(F.col("rule_version") == rule_version)
            .dropDuplicates(["blob"]))


def blob_id(text):
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def scan_secrets(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Every row of ``versions(doc_id, text)`` (any number of versions of any
    path) with its blob id and findings: ``doc_id, blob, spans``. Unseen blobs
    are scanned and appended to ``ledger``; a second run over the same rows
    scans nothing. Null text counts as empty, repeated rows each get a row,
    an empty table gives none; other columns are not read."""
    spark = versions.sparkSession
    ship_package(spark)
    rows = versions.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", blob_id(F.col("text")))
    seen = read_ledger(spark, ledger, rule_version)
    # Partial aggregation keeps one text per blob before the shuffle, so a
    # blob with a third of all rows ships once per map task.
    unseen = rows.join(seen.select("blob"), "blob", "left_anti").groupBy("blob").agg(F.first("text").alias("text"))
    (unseen.mapInArrow(_scan, f"blob string, spans array<{SPAN}>")
     .select("blob", F.lit(rule_version).alias("rule_version"), "spans")
     .write.mode("append").parquet(ledger))
    found = read_ledger(spark, ledger, rule_version).select("blob", "spans")
    return rows.select("doc_id", "blob").join(found, "blob").select("doc_id", "blob", "spans")


def spans_text(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
