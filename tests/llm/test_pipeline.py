import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
        now = {r["doc_id"]: r for r in docs.collect()}
        assert now and set(now) <= before, name
        assert all(r["n_chars"] == len(r["text"]) for r in now.values())
        if name == "quality_rules":
            assert sum(labels.get(d) == 0 for d in now) <= 0.1 * sum(q == 0 for q in labels.values())
        before = set(now)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(r["length"] for r in rows) == sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in now.values())


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
