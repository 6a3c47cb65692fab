"""The pipeline on tables with nulls, repeats, ties and nothing in them."""

import random

import pytest

import corpus_pipeline
from marketloom.llm import packing

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, docs, labels, items):
    spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in docs], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def prose(rng, n):
    return " ".join(f"word{rng.randrange(400)}" for _ in range(n)) + "."


def test_odd_rows_go_through(spark, tmp_path):
    rng = random.Random(1)
    item = prose(rng, 40)
    docs = [(i, prose(rng, rng.randrange(20, 80)) + ("" if i % 2 else "\n" + prose(rng, 12))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "  \n "), (None, prose(rng, 30)), (None, prose(rng, 30)), (103, docs[3][1]), (3, docs[3][1]), (104, prose(rng, 4000)), (105, f"{prose(rng, 10)} {item} {prose(rng, 10)}")]
    labels = [(i, 1, 0) for i in range(0, 60)]
    folder = tables(spark, tmp_path / "odd", docs, labels, [(1, item), (2, None), (3, "")])
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    # all labels are good, so nothing is rejected; a copy has lost all its lines to the first document that holds them
    assert ids == {i for i, _ in docs} - {105}
    assert {r.length for r in rows if r.doc_id in (100, 101, 103)} == {1}
    pieces = [r for r in rows if r.doc_id == 104]
    assert sum(r.length for r in pieces) == len(packing.chunk_tokenizer(corpus_pipeline.tokenizer_path()).tokenizer.encode(docs[-2][1], add_special_tokens=False).ids) + 1
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, tmp_path, empty):
    rng = random.Random(2)
    docs = [] if empty == "documents" else [(i, prose(rng, 30)) for i in range(8)]
    labels = [] if empty == "labels" else [(i, i % 2, 0) for i in range(8)]
    items = [] if empty == "benchmark" else [(1, prose(rng, 20))]
    rows = corpus_pipeline.run(spark, tables(spark, tmp_path / empty, docs, labels, items)).collect()
    if empty == "documents":
        assert rows == []
    if empty == "labels":
        assert {r.doc_id for r in rows} == set(range(8))
