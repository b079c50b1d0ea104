"""Queries that keep whole texts and all rows, against plain Python."""

from __future__ import annotations

import hashlib

from folio import catalogue
from folio.operators import text


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_normalised_texts_keep_their_tails(spark, tmp_path):
    texts = {1: "“a  b” " * 3000, 2: "x" * 4999 + "「tail」", 3: "w " * 150 + "‘end’"}
    folder = written(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in catalogue.queries()["text_normalize"](spark, folder).collect()}
    plain = {i: " ".join(t.translate(str.maketrans("“”「」", '""""')).split()) for i, t in texts.items()}
    assert {i: r["text"] for i, r in got.items()} == plain
    assert {i: r["quoted"] for i, r in got.items()} == {i: t.translate(str.maketrans("“”‘’", "\"\"''")) for i, t in texts.items()}
    cut = text.normalized(spark.read.parquet(f"{folder}/documents.parquet"), 7)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {i: t[:7] for i, t in plain.items()}


def test_keys_of_texts_with_one_opening_differ(spark, tmp_path):
    opening = "word " * 1999
    texts = {1: opening + "one", 2: opening + "two", 3: opening + "one  more"}
    folder = written(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["pov_key"] for r in catalogue.queries()["cache_keys"](spark, folder).collect()}
    assert got == {i: hashlib.sha256(("pov|" + " ".join(t.split()[:2000])).encode()).hexdigest()[:16] for i, t in texts.items()}
    assert got[1] == got[3] != got[2]


def test_all_turns_count_for_completion(spark, tmp_path):
    rows = [(c, t) for c in (7, 8, 14) for t in range(4) if (c, t) != (14, 2)]
    folder = written(spark, tmp_path, "conversations", rows, "conv_id long, turn long")
    got = {r["conv_id"]: (r["seen"], r["expected"], r["complete"], r["progress"]) for r in catalogue.queries()["job_completion"](spark, folder).collect()}
    assert got == {7: (4, 4, True, 100.0), 8: (4, 4, True, 100.0), 14: (3, 4, False, 75.0)}
