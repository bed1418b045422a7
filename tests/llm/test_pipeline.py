import zlib

import corpus_pipeline
import numpy as np

from sweepline.llm import toxicity


def test_stages_in_turn(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
        assert docs.columns == columns and docs.count() > 0, name
        if name != "mixing":
            assert docs.count() <= n
            n = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert out.count() == docs.count()


def test_run_decides_as_its_stages(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    out = sorted(corpus_pipeline.run(spark, data).collect(), key=lambda r: r.start)
    kept = {r.doc_id for r in out}
    judged = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    assert kept and 1 in judged.values() and not any(judged[i] for i in kept)
    assert len({texts[i] for i in kept}) == len(kept)
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert any(item in text for item in items for text in texts.values())
    assert not any(item in texts[i] for item in items for i in kept)
    start = 0
    for r in out:
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
