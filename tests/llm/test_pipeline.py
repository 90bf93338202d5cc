"""The pipeline stage by stage, each judged on its own input."""

from collections import Counter

import corpus_pipeline
from cases import frame, texts
from dealsift.llm import bpe, decontaminate, language, near_dedup, substring
from dealsift.llm.catalog import tokenizer
from dealsift.llm.tables import read, stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), "test")
        if name == "language":
            expected = {r.doc_id for r in language.identify(docs).collect() if r.lang_pred != "und" and r.score >= 0.2}
        elif name == "near-dedup":
            expected = {r.doc_id for r in near_dedup.dedup(docs).filter("kept").collect()}
        elif name == "substring-dedup":
            expected = {r.doc_id for r in docs.collect()}
            kept = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
            before = {r.doc_id: r.text for r in docs.collect()}
            for r in out.collect():
                assert r.text == (kept[r.doc_id].kept if kept[r.doc_id].n_removed else before[r.doc_id]) and r.n_chars == len(r.text)
        elif name == "decontamination":
            found = {r.doc_id for r in decontaminate.find(docs, read(spark, SF, "benchmark")).collect()}
            expected = {r.doc_id for r in docs.collect()} - found
        else:
            expected = {r.doc_id for r in docs.collect()}
            assert sorted(map(tuple, out.collect())) == sorted(map(tuple, bpe.round_trip(docs, tokenizer("byte_bpe_50k.json")).collect()))
        assert {r.doc_id for r in out.collect()} == expected
        assert name == "bpe" or out.columns == columns
        docs = out


def test_awkward_rows(spark, tmp_path):
    frame(spark, texts()).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (2, "w1 w2 w3 w4 w5 w6")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got[7] == 1 and not {1, 2, 3, 8} & set(got)


def test_nothing(spark, tmp_path):
    frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
