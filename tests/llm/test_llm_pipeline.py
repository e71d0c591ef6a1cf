"""The pipeline: every stage against a brute-force version on what the stage before has kept."""

import hashlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cohortlake.llm import bpe, decontamination, toxicity
from cohortlake.session import written
from test_llm_documents import SCHEMA, component_of, odd_rows, removed

FOLDER = "/root/testdata/sf0.001"
CLASHING = "ids score predicted offending n_words n_removed spans row key t cut at gone _text rep component_id part item_id a.b".split()


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "substring_dedup", "decontamination", "byte_bpe"]


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")))
    rows = {r["doc_id"]: r for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}
    columns, states = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), name)
        if name != "byte_bpe":
            assert docs.columns == columns
        states.append({r["doc_id"]: r.asDict() for r in docs.collect()})
    toxic = {d for d, r in rows.items() if model.score([r["text"]])[0][0] >= 0.5}
    want = {d: r for d, r in rows.items() if d not in toxic}
    assert states[0] == want
    root = component_of([(d, r["text"]) for d, r in want.items()])
    want = {d: r for d, r in want.items() if root[d] == d}
    assert states[1] == want
    cut = {d: (n, gone, kept) for d, n, gone, kept in removed([(d, r["text"]) for d, r in want.items()], 20)}
    for d, (n, gone, kept) in cut.items():
        if gone:
            want[d] = want[d] | {"text": kept.decode(), "n_chars": len(kept.decode())}
    want = {d: r for d, r in want.items() if not cut[d][0] or cut[d][1] < cut[d][0]}
    assert states[2] == want
    items = [decontamination.words(r["text"].encode()) for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()]
    leaks = {d for d, r in want.items() if any(decontamination.distance(i, decontamination.words(r["text"].encode()))[0] <= int(0.2 * i.size) for i in items)}
    want = {d: r for d, r in want.items() if d not in leaks}
    assert states[3] == want
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    assert set(states[4]) == set(want)
    for d, r in want.items():
        assert states[4][d]["ids"] == enc.encode_ordinary(r["text"]) and states[4][d]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", *[f"'mine' as `{c}`" for c in CLASHING], "map('k', doc_id) as pairs")
    out = stage(spark, docs, FOLDER)
    rows = out.collect()
    if name == "byte_bpe":
        assert len(rows) == len(odd_rows())
    else:
        assert out.columns == docs.columns and {r[c] for r in rows for c in CLASHING} == {"mine"}
    if name == "ngram_join":
        assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 10, 11, 12, 13, 14, 15]
        assert sum(r["doc_id"] is None for r in rows) == 2
    if name == "substring_dedup":
        assert {r["doc_id"] for r in rows} >= {1, 4, 5, 6, 7, 8, 10}
    assert stage(spark, docs.limit(0), FOLDER).collect() == []
