"""The pipeline: every stage's decisions take effect on what is left before it."""

import corpus_pipeline as cp
from coweave.llm import classifier, exact_dedup, simhash, suffix_dedup
from coweave.session import cut_lineage

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["classify", "exact", "near", "repeats", "pack"]


def test_each_stage_on_what_its_predecessor_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, states = docs.columns, [docs]
    for _, stage in cp.STAGES:
        states.append(cut_lineage(stage(spark, states[-1], SF)))
    raw, classified, exact, near, cut, packed = states
    assert all(s.columns == columns for s in states[:-1])
    ids = [[r["doc_id"] for r in s.select("doc_id").collect()] for s in states]
    kept = {r["doc_id"] for r in classifier.classify(raw, labels).where("kept").collect()}
    assert set(ids[1]) == kept and 0 < len(kept) < len(ids[0])
    assert set(ids[2]) == {r["doc_id"] for r in exact_dedup.exact_duplicates(classified).where("kept").collect()}
    assert set(ids[3]) == {r["component_id"] for r in simhash.simhash_classes(exact).collect()}
    assert sorted(ids[4]) == sorted(ids[3])
    left = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in suffix_dedup.remove_repeats(near).collect()}
    assert {r["doc_id"]: len(r["text"].encode()) for r in cut.collect()} == left       # ASCII cuts only here
    assert set(ids[5]) == set(ids[4])
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())


def test_whole_run(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = cut_lineage(stage(spark, docs, SF))
        assert docs.count() == 0
