import os

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import bpe, quality, queries, toxicity

from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline_against_brute_force(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    machine = toxicity.train(docs, labels)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if machine.score(t) < 0.5}
    left = docs.where(docs.doc_id.isin(list(rows)))
    field = quality.train(left, labels)
    rows = {i: t for i, t in rows.items() if field.scores([t])[0] >= 0.3}
    last = {}
    for i in sorted(rows):
        last[rows[i]] = i
    rows = {i: t for t, i in last.items()}
    fps = {i: plain_fingerprint(t) for i, t in rows.items()}
    rows = {i: rows[i] for i, root in plain_components(fps).items() if i == root}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(rows)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert size == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows.items()}


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(["a b c d", "a b c d", None, "", "x y z " * 50])], kind)
    spark.createDataFrame([(0, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact dedup", "near dedup", "packing"]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert bpe.tokenizer_file("byte_bpe_50k.tiktoken").endswith("tiktoken")
