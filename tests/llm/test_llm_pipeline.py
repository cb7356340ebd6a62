"""Each stage of the pipeline on a small table, judged on its own input."""

import datetime
import hashlib

import numpy as np
import pytest
from test_llm_text import corpus, covered, shingles

import __spark_entry__
import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept_id string, row int, n_bytes timestamp, kept_text string, n_removed array<int>, n_spans map<string,double>, kept_sha256 binary"
AT = datetime.datetime(2024, 2, 29, 12, 30, 15, 123456)
MORE = (1, 2, "k", 3, AT, "kept", [1, None], {"a": 0.1}, b"\x00\xff")


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    rows = [(*r[:4], *MORE) for r in corpus()]
    toxic = [(200 + k, f"{r[1]} vilegrumble", "en", "s1", *MORE) for k, r in enumerate(corpus()[:40])]
    docs = spark.createDataFrame(rows + toxic, SCHEMA)
    docs.write.parquet(f"{root}/documents.parquet")
    labels = [(r[0], 1, int(r[0] >= 200)) for r in [*rows, *toxic] if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    out, current = {"documents": spark.read.parquet(f"{root}/documents.parquet")}, None
    for name, work in corpus_pipeline.STAGES:
        current = out[list(out)[-1]]
        work(spark, current, str(root)).write.parquet(f"{root}/{name}")
        out[name] = spark.read.parquet(f"{root}/{name}")
    return root, out


def test_columns_and_clean_documents_stay(staged):
    _, out = staged
    names = list(out)
    assert all(out[n].columns == out["documents"].columns for n in names[:-1])
    first = out["toxicity"].collect()
    assert not any("vilegrumble" in (r["text"] or "") for r in first)
    assert len(first) == len(corpus())


def test_one_of_each_group_stays(staged):
    _, out = staged
    kept = [r for r in out["minhash_near_dedup"].collect() if r["doc_id"] is not None]
    sets = [(r["doc_id"], shingles(r["text"])) for r in kept]
    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            assert a == b or not (s and t and 100 * len(s & t) >= 75 * len(s | t))
    assert len([r for r in out["minhash_near_dedup"].collect() if r["doc_id"] is None]) == 2


def test_passages_go(staged):
    _, out = staged
    before = [r for r in out["minhash_near_dedup"].collect() if r["doc_id"] not in (None, 70)]
    after = {r["doc_id"]: r["text"] for r in out["suffix_array_dedup"].collect()}
    for own, mark in covered(sorted((r["doc_id"], (r["text"] or "").encode()) for r in before)).items():
        raw = next((r["text"] or "").encode() for r in before if r["doc_id"] == own)
        want = bytes(np.frombuffer(raw, np.uint8)[~mark]).decode("utf-8", "ignore")
        assert hashlib.sha256(after[own].encode()).digest() == hashlib.sha256(want.encode()).digest()


def test_mix_repeats_at_most_twice_and_encoding_comes_back(staged):
    _, out = staged
    before = {(r["doc_id"], r["text"]) for r in out["suffix_array_dedup"].collect()}
    mixed = out["mix_sources"].collect()
    assert {(r["doc_id"], r["text"]) for r in mixed} <= before
    assert max(sum(r["doc_id"] == k for r in mixed) for k in {r["doc_id"] for r in mixed if r["doc_id"] not in (None, 70)}) <= 2
    assert out["sentencepiece"].count() == len(mixed) and out["sentencepiece"].where("not round_trip").count() == 0


def test_other_columns_come_through_unchanged(staged):
    _, out = staged
    for name in list(out)[1:-1]:
        assert {(r["size"], r["kept_id"], r["row"], r["n_bytes"], r["kept_text"], tuple(r["n_removed"]), r["n_spans"]["a"], bytes(r["kept_sha256"])) for r in out[name].collect()} == {(2, "k", 3, AT, "kept", (1, None), 0.1, b"\x00\xff")}


def test_stages_may_be_chained_without_writing(spark, staged):
    root, out = staged
    docs = out["documents"]
    for _, work in corpus_pipeline.STAGES[:4]:
        docs = work(spark, docs, str(root))
    key = lambda df: sorted(str((r["doc_id"], r["text"])) for r in df.collect())
    assert key(docs) == key(out["mix_sources"])


def test_run_does_all_stages(spark, staged):
    root, out = staged
    assert sorted(map(str, corpus_pipeline.run(spark, str(root)).collect())) == sorted(map(str, out["sentencepiece"].collect()))


def test_empty_tables_go_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "n_pieces", "round_trip", "ids"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, work in corpus_pipeline.STAGES[:4]:
        assert work(spark, docs, str(tmp_path)).columns == docs.columns


def test_all_thirteen_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
