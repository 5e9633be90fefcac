from pathlib import Path

import pytest

from meridian.llm import frames

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_clean_documents_and_columns(spark, awkward, empty, tmp_path):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    spark.createDataFrame([(1, " ".join((docs[12][1] or "").split()[55:75]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).collect() == []
        at = stage(spark, at, str(tmp_path))
        assert at.columns == awkward.columns, name
    kept = {r["doc_id"]: r for r in at.collect()}
    assert {1, 4, 5, 6, 7, 8, 13, 15}.issubset(kept) and not {2, 3, 10} & set(kept)
    assert "[SECRET]" in kept[15]["text"] and kept[15]["n_chars"] == len(kept[15]["text"]) and kept[7]["text"] == dict(docs)[7]
    last = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    assert len(last) == at.count() and all(4 * r["n_tokens"] == len(r["ids"]) for r in last)


def test_stages_leave_only_what_their_result_reads(spark):
    """Near duplicates and decontamination keep the table of dropped rows; sets, lists and postings go with the call."""
    folder_of_tables = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder_of_tables}/documents.parquet")
    folder = Path(frames.table_folder(spark).removeprefix("file:"))
    tables = lambda: {p.name for p in folder.iterdir()} if folder.exists() else set()
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated):
        before = tables()
        out = stage(spark, docs, folder_of_tables)
        assert {name.rpartition("-")[0] for name in tables() - before} == {"gone"}
        assert 0 < out.count() <= docs.count()
