from pathlib import Path

import corpus_pipeline
from tests.llm.conftest import sentences


def write(spark, folder: Path, docs):
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, sentences(8, 60)), (2, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))


def test_stages_take_effect_one_after_the_other(spark, docs, tmp_path):
    write(spark, tmp_path, docs)
    left, names = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
        left.write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        names.append(name)
    ids = sorted(r["doc_id"] or -1 for r in left.collect())
    # Blank, short and junk texts went first, then copies, then the two with a benchmark passage.
    assert ids == sorted([-1, 1, 4, 10, 14, 15, 19])
    assert all("0123456789abcdef" not in r["text"] and "AKIA" not in r["text"] for r in left.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).collect()
    assert {r["doc_id"] or -1 for r in packed} == set(ids)
    assert {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "ids_crc32").collect()} == {(r["doc_id"], r["start"], r["ids_crc32"]) for r in packed}


def test_empty(spark, no_docs, tmp_path):
    write(spark, tmp_path, no_docs)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
