"""The corpus pipeline: every stage against a plain form of its decision."""

import re

import corpus_pipeline
from flowlens.llm.secrets import BASE_KINDS, find_secrets
from flowlens.operators._small import materialize
from tests.llm.test_decontaminate import plain as passages
from tests.llm.test_ngram_join import plain as classes

SF = "/root/testdata/sf0.001"


def test_each_stage_decides_on_all_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "near_duplicates", "benchmark_passages", "secrets", "source_mix"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(after) and set(after) <= set(before)
        if name != "source_mix":
            assert docs.columns == columns
        if name != "secrets":
            assert all(after[i] == before[i] for i in after)
        if name == "language":
            lost = [i for i in before if i not in after]
            assert all(re.search(r"[^\W\d_]", after[i] or "") for i in after) and len(lost) <= .05 * len(before)
        if name == "near_duplicates":
            assert set(after) == {c for c, _ in classes(list(before.items()))} and len(after) < len(before)
        if name == "benchmark_passages":
            assert set(after) == {i for i, t in before.items() if not passages(t, items)[1]}
        if name == "secrets":
            assert set(after) == set(before)
            found, spans = find_secrets(docs, keep=["doc_id"])
            assert not [r for r in found.collect() for s in r[spans] if s["kind"] in BASE_KINDS]
        if name == "source_mix":
            rows = docs.collect()
            assert {"taken", "target"} <= set(docs.columns) and all(0 < r.taken <= 2 * r["size"] for r in rows)


def test_run_equals_the_stages_and_reruns_agree(spark):
    first = sorted(map(repr, corpus_pipeline.run(spark, SF).collect()))
    assert first and first == sorted(map(repr, corpus_pipeline.run(spark, SF).collect()))


def test_stages_with_null_ids_empty_texts_and_clashing_names(spark):
    words = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 200").orderBy("doc_id").limit(30).collect()]
    rows = [(None if i % 7 == 0 else i, t, "en", None if i % 3 == 0 else "web", len(t), i, i, i, i, i) for i, t in enumerate(words)]
    rows += [(100, None, None, "web", 0, 1, 1, 1, 1, 1), (101, "", "en", None, 0, 1, 1, 1, 1, 1), rows[1],
             (102, words[2] + " token=abcdef1", "en", "web", 0, 1, 1, 1, 1, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, taken int, redacted int, s int, node int, pattern int"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        given = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            columns, before = docs.columns, docs.count()
            docs = materialize(stage(spark, docs, SF), f"test-{name}")
            assert docs.columns[:len(columns)] == columns and docs.count() <= before, name
            assert docs.where("taken IS NULL OR node IS NULL").count() == 0
        assert (docs.count() > 10) == (given > 0)
