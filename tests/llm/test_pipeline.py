"""The pipeline, stage by stage, against what each stage promises."""

import os

import corpus_pipeline
import pytest
from test_minhash import brute as groups
from test_packing import REF
from test_quality import brute as counts

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    odd = spark.createDataFrame(
        [(5000, None, None, None, None), (None, "the of and to in is it that for on with as", "en", None, 1)], docs.schema
    )
    docs = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF_DIR).cache()
        out.append((docs, made))
        docs = made
    return out


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near duplicates", "personal data", "packing"]
    for docs, made in stages[:-1]:
        assert made.columns == list(corpus_pipeline.COLUMNS)
        assert made.dtypes == docs.select(*corpus_pipeline.COLUMNS).dtypes


def test_quality_stage(stages):
    docs, made = stages[0]
    kept = {r.doc_id for r in made.collect()}
    for r in docs.collect():
        if counts(r.text)[5]:
            assert r.doc_id not in kept
    assert len(kept) > 0.7 * docs.count()


def test_near_duplicate_stage(stages):
    docs, made = stages[2]
    rows = sorted((r for r in docs.collect() if r.doc_id is not None), key=lambda r: r.doc_id)
    part = [p for _, p in groups([r.text for r in rows], 5, 80)]
    want = {r.doc_id for k, r in enumerate(rows) if part[k] == k}
    assert {r.doc_id for r in made.collect() if r.doc_id is not None} == want


def test_personal_data_stage(stages):
    docs, made = stages[3]
    before, after = ({r.doc_id: r for r in t.collect()} for t in (docs, made))
    assert before.keys() == after.keys()
    changed = [k for k in before if before[k].text != after[k].text]
    assert changed and all("[" in after[k].text and "@mail" not in after[k].text for k in changed)
    assert all(after[k].n_chars == len(after[k].text) for k in changed)
    assert all(before[k] == after[k] for k in before.keys() - set(changed))


def test_packing_stage(stages):
    docs, made = stages[4]
    want = {r.doc_id: REF.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    got = {}
    for p in sorted(made.collect(), key=lambda p: p.start):
        got.setdefault(p.doc_id, []).append(p)
    assert got.keys() == want.keys()
    assert all(sum(p.length for p in got[k]) == len(want[k]) for k in want)
    assert all(p.offset + p.length <= 4096 for ps in got.values() for p in ps)
