"""The pipeline against plain versions of its stages, and the queries of this subpackage."""

from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from folio.llm import registry, simhash

from .test_dedup import lowered, slow_fingerprint, slow_groups


def test_stages_keep_what_plain_versions_keep(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 3000")
    odd = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "12 34", "en", "s", 5), (9003, "", "en", "s", 0)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [r for r in docs.collect()]
    texts = {}
    for r in rows:
        texts[lowered(r["text"])] = max(r["doc_id"], texts.get(lowered(r["text"]), -1))
    kept = sorted(texts.values())
    by_id = {r["doc_id"]: r["text"] for r in rows}
    groups = slow_groups([(i, [slow_fingerprint(by_id[i], 5, k) for k in range(8)]) for i in kept])
    want = {i for i in kept if groups[i] == i}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == want
    sequences = defaultdict(int)
    for r in got:
        sequences[r["sequence_id"]] += r["length"]
    assert max(sequences.values()) <= 4096
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "best_fit_packing"]


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_gives_the_rows_of_its_sql(name, spark, sf_dir, same):
    same(registry.queries()[name](spark, sf_dir), registry.oracles()[name])


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert simhash.QUERIES


def test_documents_stay_where_no_language_is_known(spark, sf_dir):
    rows = [(2, "plain text", None, "s", 10), (3, "другой", None, "s", 6), (4, "12 34", None, "s", 5), (5, None, None, "s", 0)]
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    kept = corpus_pipeline.identified(spark, spark.createDataFrame(rows, schema), sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_stages_of_empty_tables_repeated_ids_and_clashing_names(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "a", 1, "x", 0), (1, words.upper(), "en", "b", 2, "x", 0), (1, "other text", None, "c", 3, "x", 0), (None, None, "en", "d", 4, "x", 0), (2, words + " end", "en", "e", 5, None, 0), (3, "", "en", "f", 6, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, TEXT string, part int")
    kept = corpus_pipeline.identified(spark, docs, sf_dir)
    assert kept.columns == docs.columns and sorted(r[4] for r in kept.collect()) == [1, 2, 3, 5]
    kept = corpus_pipeline.exact(spark, kept, sf_dir)
    assert kept.columns == docs.columns
    left = [r[4] for r in kept.collect()]
    assert sorted(left) in ([1, 3, 5], [2, 3, 5])
    kept = corpus_pipeline.near(spark, kept, sf_dir)
    assert kept.columns == docs.columns and sorted(r[4] for r in kept.collect()) in ([1, 3], [2, 3])
    assert corpus_pipeline.pack(spark, kept, sf_dir).count() == 2
