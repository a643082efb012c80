"""Secret spans against a plain regex loop; the ledger's increments."""

import re

from pyspark.sql import functions as F

from marquee.llm import secret_scan as ss
from tests.llm.fixtures import documents, frame, with_clashes

EXTRA = ["password = hunter2hunter2, PassWD:'abcdef' x", "token=token: abcdefgh", "api_key:\"Zz9+/_.=-\" APIKEY = short",
         "AKIA" + "A1" * 8 + " AKIAAB AKIA" + "B" * 40, "x" + "0f" * 12 + "g" + "ab" * 11 + "G" + "dead" * 9,
         "ſecret=abcdefgh toKen = abcdefgh", "ghp_" + "a1B2" * 10 + " -----BEGIN RSA PRIVATE KEY-----", "secret:\x20\x20:abcdef",
         "😀 token=" + "a" * 30 + "😀" + "b" * 30]


def brute(t):
    t, out = t or "", []
    rules = {"assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
             "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24)}
    for n, (k, (p, g, least)) in enumerate(rules.items()):
        out += [(m.start(), n, k, m.end()) for m in re.finditer(p, t, re.ASCII) if len(m[g]) >= least]
    return [(k, a, z) for a, _, k, z in sorted(out)]


def data():
    return documents() + [(5000 + i, t, "en", "s", 1) for i, t in enumerate(EXTRA + EXTRA[:3])]


def test_spans_equal_plain_regexes():
    for t in EXTRA + [r[1] for r in documents()]:
        assert [s for s in ss.find_secrets(t) if s[0] in ss.BASE] == brute(t)
    assert {"github", "pem"} <= {s[0] for s in ss.find_secrets(EXTRA[6])}


def test_ledger_scans_only_unseen(spark, tmp_path):
    path, rows = str(tmp_path / "ledger"), data()
    df = with_clashes(frame(spark, rows))

    def spans(r):
        return [(s.kind, s.start, s.end) for s in r.spans if s.kind in ss.BASE]
    got = ss.scan_secrets(df, path).collect()
    assert sorted(((r.doc_id, spans(r)) for r in got), key=repr) == sorted(((r[0], brute(r[1])) for r in rows), key=repr)
    blobs = {r[1] or "" for r in rows}
    assert spark.read.parquet(path).count() == len(blobs)
    assert len(ss.scan_secrets(df, path).collect()) == len(rows)
    assert spark.read.parquet(path).count() == len(blobs)
    more = df.unionByName(df.limit(1).withColumn("text", F.lit("token=new-version-1")))
    ss.scan_secrets(more, path)
    assert spark.read.parquet(path).count() == len(blobs) + 1
    ss.scan_secrets(df, path, "3")
    assert spark.read.parquet(path).count() == 2 * len(blobs) + 1


def test_empty_table(spark, tmp_path):
    assert ss.scan_secrets(frame(spark).limit(0), str(tmp_path / "l")).collect() == []
