"""The registered queries: SQL where there is some, brute force where not, and
the pipeline's stages against their own definitions."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from marquee.llm import decontaminate as dc, mixing, toxicity as tx
from marquee.llm.queries import ORACLE, QUERIES
from tests.conftest import SF001, SF01
from tests.llm.test_decontaminate import words as norm_words
from tests.llm.test_mixing import WORD, check
from tests.llm.test_near_dedup import brute as near_brute
from tools.oracle_check import rows_of


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id").fetchall()


def test_every_operator_is_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, con, name):
    df = QUERIES[name](spark, SF001)
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


def test_op1(spark, docs):
    got = sorted(map(tuple, QUERIES["op1_minhash_near_dedup"](spark, SF001).collect()))
    assert got == near_brute(docs)


def test_op3(spark, con):
    turns = con.execute("SELECT conv_id, turn, role, coalesce(text, '') FROM conversations").fetchall()
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for c in {t[0] for t in turns}:
        own = sorted(t[1:] for t in turns if t[0] == c)
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        want[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: tuple(r)[1:5] for r in QUERIES["op3_chat_formatting"](spark, SF001).collect()}
    assert got == want


def test_op4(spark, con, docs):
    rows = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, SF001).collect()}
    assert set(rows) == {d[0] for d in docs}
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    labels = dict(con.execute("SELECT doc_id, toxic FROM labels").fetchall())
    told = [(rows[d].predicted, y) for d, y in labels.items() if d in rows and y is not None]
    assert sum(p == y for p, y in told) >= 0.9 * len(told)


def test_op6(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    kinds = {"assign": re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
             "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    least = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    order = list(kinds)
    want = {}
    for d, t, *_ in docs:
        found = [(m.start(), order.index(k), k, m.end()) for k, rx in kinds.items() for m in rx.finditer(t or "") if least[k](m)]
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
        want[d] = (*[sum(f[2] == k for f in found) for k in order], hashlib.sha256(said.encode()).hexdigest())
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in QUERIES["op6_secret_scan"](spark, SF01).collect()}
    assert got == want and any(any(w[:3]) for w in want.values())


def test_op7(spark, docs):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t, *_ in docs:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 512))
    assert sorted(map(tuple, QUERIES["op7_token_counts"](spark, SF001).collect())) == sorted(want)


def test_op10(spark, docs):
    rows = QUERIES["op10_source_mixing"](spark, SF001).collect()
    source = {d[0]: d[3] for d in docs}
    size = {d[0]: len(WORD.findall(d[1] or "")) for d in docs}
    names = sorted(set(source.values()), key=lambda x: (x is None, x or ""))
    of = {n: sum(size[d] for d in size if source[d] == n) for n in names}
    goal = dict(zip(names, mixing.targets([of[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken = dict.fromkeys(names, 0)
    for r in rows:
        assert (r["size"], r.source_size) == (size[r.doc_id], of[source[r.doc_id]]) and abs(r.target - goal[source[r.doc_id]]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert len(rows) == len(docs) and all(abs(taken[n] - goal[n]) <= 32 for n in names)
    again = QUERIES["op10_source_mixing"](spark, SF001).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_op8(spark, docs):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for d, t, *_ in docs:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op8_token_files"](spark, SF001).collect())) == want


def test_pipeline_stages(spark, con, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    rows = spark.read.parquet(f"{SF001}/documents.parquet").persist()
    columns = rows.columns
    stages = dict(corpus_pipeline.STAGES)
    left = {r[0]: r for r in docs}

    out = stages["toxicity"](spark, rows, SF001).persist()
    scores = tx.score_toxicity(rows, spark.read.parquet(f"{SF001}/labels.parquet")).collect()
    left = {r.doc_id: left[r.doc_id] for r in scores if r["__score"] < tx.THRESHOLD}
    assert out.columns == columns and {tuple(r) for r in out.collect()} == set(left.values())

    out = stages["near_dedup"](spark, out, SF001).persist()
    kept = {r[0] for r in near_brute(list(left.values()), 5, 80) if r[3]}
    left = {k: v for k, v in left.items() if k in kept}
    assert out.columns == columns and {tuple(r) for r in out.collect()} == set(left.values())

    out = stages["decontamination"](spark, out, SF001).persist()
    windows = set()
    for _, t in con.execute("SELECT item_id, text FROM benchmark").fetchall():
        w = norm_words(t)
        n = min(dc.WINDOW, len(w))
        windows |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(w) for w in windows}

    def clean(t):
        w = norm_words(t)
        return not any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    left = {k: v for k, v in left.items() if clean(v[1])}
    assert out.columns == columns and {tuple(r) for r in out.collect()} == set(left.values())

    check(list(left.values()), [r.asDict() for r in mixing.plan_mix(out).collect()])
    taken = {r.doc_id: r["__taken"] for r in mixing.plan_mix(out).collect()}
    out = stages["mixing"](spark, out, SF001).persist()
    assert out.columns == columns
    mixed = [tuple(r) for r in out.collect()]
    for d in left:
        assert taken[d] == sum(len(WORD.findall(r[1])) for r in mixed if r[0] == d)

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for r in sorted(mixed, key=lambda r: (r[0], r[1])):
        ids = lib.encode(r[1], add_special_tokens=False).ids + [2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, stages["token_output"](spark, out, SF001).collect()), key=lambda r: r[1]) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF001).collect()), key=lambda r: r[1]) == want
