"""Registered text queries against their SQL twins; the others against brute force on whole tables."""

import hashlib
import os
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402
from alertsift.llm import catalog  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


def test_all_are_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in catalog.QUERIES}
    assert "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, name):
    note, _, good = check.compare(spark, check.oracle(SF_DIR), SF_DIR, name, QUERIES[name], SQL[name])
    assert good, note


def test_codes_and_pieces(spark):
    reference = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r.doc_id: reference.encode(r.text or "", add_special_tokens=False).ids for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op2_bpe"](spark, SF_DIR).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(rows) == len(docs)
    for r in rows:
        ids = docs[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(reference.decode(ids, skip_special_tokens=False))
    pieces = QUERIES["op8_packing"](spark, SF_DIR).collect()
    assert sum(p.length for p in pieces) == sum(len(i) + 1 for i in docs.values())
    for p in pieces:
        ids = np.array([*docs[p.doc_id], 2], "<u4")[p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(ids.tobytes()) and p.doc_tokens == len(docs[p.doc_id]) + 1


def test_toxicity_columns(spark):
    df = QUERIES["op3_toxicity"](spark, SF_DIR)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = df.collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_personal_data_columns(spark):
    from test_pii import brute

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op9_pii"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        for kind in ("email", "ip", "card", "phone"):
            assert r[f"n_{kind}"] == base.count(f"{kind}:")
