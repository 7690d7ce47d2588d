"""Texts of eight megabytes, in one line and in many, and no texts at all."""

import pytest
from tests.llm import cases

import corpus_pipeline
from larderflow.llm import exact_dedup, fingerprints, language_id, license_scan, line_dedup, mixing, packing, quality, sharding, simhash

WORDS = 990_000


@pytest.fixture(scope="module")
def long(spark):
    one = " ".join(f"w{i:06d}" for i in range(WORDS))
    many = "\n".join(" ".join(f"l{i:06d}" for i in range(k, k + 10)) for k in range(0, WORDS, 10))
    rows = [cases.doc(1, one), cases.doc(2, many), cases.doc(3, one), cases.doc(4, "short"), cases.doc(5, many + "\nend", "de")]
    return cases.table(spark, rows, partitions=2).persist()


def test_native_operators(long):
    assert {r.doc_id: r.kept for r in exact_dedup.dedup(long).collect()} == {1: False, 2: True, 3: True, 4: True, 5: True}
    prints = {r.doc_id: (r.fingerprint, r.n_chars) for r in fingerprints.fingerprint(long).collect()}
    assert prints[1] == prints[3] and len(set(prints.values())) == 4 and prints[1][1] == 8 * WORDS - 1
    assert sorted(r.size for r in sharding.shard(long).collect())[0] == 13
    assert {r.doc_id: r.size for r in mixing.mix(long).collect()} == {1: WORDS, 2: WORDS, 3: WORDS, 4: 1, 5: WORDS + 1}
    assert all(r.license is None and not r.n_notices for r in license_scan.scan(long).collect())


def test_packing(long):
    got = packing.pack_documents(long).groupBy("doc_id").sum("size").collect()
    assert dict(map(tuple, got)) == {1: WORDS + 1, 2: WORDS + 1, 3: WORDS + 1, 4: 2, 5: WORDS + 2}


def test_models(long):
    model = language_id.train(long)
    assert {r.doc_id: r.lang_pred for r in language_id.identify(long, model).collect()}.keys() == {1, 2, 3, 4, 5}
    labels = long.sparkSession.createDataFrame([(i, i % 2, 0) for i in range(1, 6)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.score(long, quality.train(long, labels)).collect())


def test_duplicates(long):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(long).collect()}
    assert got[3] == 1 and got[5] == got[2] == 2
    alike = {r.doc_id: r.component_id for r in simhash.similar(long, keys="doc_id").collect()}
    assert alike == {1: 1, 2: 2, 3: 1, 4: 4, 5: 2}
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(long).collect()}
    assert (left[3], left[5], len(left[1])) == ("", "end", 8 * WORDS - 1)


def test_stages_of_nothing(spark):
    docs = cases.table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
