"""The pipeline's stages against what each is meant to keep, and the queries' names."""

import os

import pytest

import __spark_entry__
import corpus_pipeline
from threadmap.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from threadmap.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries() and set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_pipeline_keeps_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r["doc_id"] for r in toxicity.scored(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0").collect()}
    ids = lambda: docs.where(docs["doc_id"].isin(sorted(left)))
    left = {r["doc_id"] for r in exact_dedup.duplicates(ids()).where("kept").collect()}
    left -= {r["doc_id"] for r in near_dedup.near_duplicates(ids()).collect()}
    left -= {r["doc_id"] for r in decontaminate.contaminations(ids(), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    want = {r["doc_id"]: r["ids_sha256"] for r in bpe.encoded(ids(), tokenizer_path("word_bpe_49k.json"), ids=False).collect()}
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"]: r["ids_sha256"] for r in got.select("doc_id", "ids_sha256").collect()} == want and want


def test_texts_reach_the_encoder_in_small_batches(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    def sizes(spark, docs, sf_dir):
        return docs.coalesce(1).mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")

    spark.range(2000).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("bpe", sizes)])
    got = [r["n"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(got) == 2000 and max(got) <= 500
