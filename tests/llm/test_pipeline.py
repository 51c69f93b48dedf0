"""Each stage of the pipeline against brute force on its own input; the registered queries against SQL."""

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from edges import documents
from oracle import connect, spark_rows, sql_rows
from test_decontaminate import brute as leak_brute
from test_exact_dedup import brute as exact_brute
from test_exact_dedup import normal
from test_near_dedup import brute as near_brute

import corpus_pipeline
from graphloom.llm import quality, queries


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        if k == 0:
            want = accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rows)
        elif k == 1:
            want = {i for i, _, _, kept, _ in exact_brute(rows) if kept}
        elif k == 2:
            want = {i for i, _, _, kept in near_brute(rows, 5) if kept}
        elif k == 3:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            want = {i for i, _ in rows} - {d for d, _ in leak_brute(rows, items)}
        else:
            want = {i for i, _ in rows}
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == want, name
        if k < 4:
            assert out.columns == columns
            docs = out
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            texts = dict(rows)
            for r in out.collect():
                assert r["ids"] == library.encode(texts[r["doc_id"]] or "") and r["n_pieces"] == len(r["ids"]) and r["round_trip"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == want


def accepted(docs, labels, rows) -> set[int]:
    """Rows whose score, summed over every pair of features, reaches the threshold."""
    model = quality.fit(docs, labels)
    out = set()
    for i, t in rows:
        stats, words = quality.structure((t or "").encode())
        ids, values = quality.features(stats, quality.hashed_words(words, quality.WORD_DIMS), model.edges)
        f = model.machine.factors[ids].astype(float) * values[:, None]
        raw = model.machine.bias + float((model.machine.weights[ids] * values).sum()) + float(np.triu(f @ f.T, 1).sum())
        if raw >= np.log(0.3 / 0.7):
            out.add(i)
    return out


def test_dropping_stages_keep_odd_rows_whole(spark, tmp_path):
    """Null and empty texts, clashing columns: one row of each group, nothing else touched."""
    df = documents(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "an item that is nowhere to be found in any of these")], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    before = df.collect()
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        rows = out.collect()
        assert set(rows) <= set(before), name
        if name != "MinHash near-dedup":
            assert {normal(r["text"]) for r in rows} == {normal(r["text"]) for r in before}, name


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == sql_rows(connect(sf_dir), queries.ORACLE_SQL[name])
