"""The pipeline's stages, one after another, against brute force on a small scale."""

import os
from collections import Counter

import numpy as np

import corpus_pipeline
from rasterloom.llm import decontaminate, near_dup
from rasterloom.llm.common import shared_folder

DIR = "/root/testdata/sf0.001"


def without_repeats(texts, p):
    """Texts without the runs, of p.words words at least, that windows with an equal elsewhere cover."""
    raw = [x.encode() for x in texts]
    seen = Counter(x[i : i + p.length] for x in raw for i in range(len(x) - p.length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 2, np.int8)
        for i in range(len(x) - p.length + 1):
            if seen[x[i : i + p.length]] > 1:
                gone[i + 1 : i + 1 + p.length] = 1
        runs = np.flatnonzero(np.diff(gone)).reshape(-1, 2)
        rest, at = b"", 0
        for a, b in runs:
            if len(x[a:b].split()) >= p.words:
                rest, at = rest + x[at:a], b
        out.append((rest + x[at:]).decode(errors="ignore"))
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dup", "exact_substrings", "decontamination", "packing"]


def test_stages_do_their_work(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        before[name], docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
    rows = {n: d.collect() for n, d in before.items()} | {"end": docs.collect()}
    assert len(rows["near_dup"]) == len(rows["language_id"])  # every text is in a known language
    bags = [set(near_dup.cells([r.text], 5)[0].tolist()) for r in rows["near_dup"]]
    ids = [r.doc_id for r in rows["near_dup"]]
    kept = {r.doc_id for r in rows["exact_substrings"]}
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    assert {min(ids[i] for i in range(len(ids)) if label[i] == x) for x in set(label)} == kept
    whole = sorted((r.doc_id, r.text) for r in rows["exact_substrings"])
    texts = without_repeats([x for _, x in whole], corpus_pipeline.PASSAGES)
    left = {r.doc_id: (r.text, r.n_chars) for r in rows["decontamination"]}
    assert {i: (x, len(x)) for (i, _), x in zip(whole, texts, strict=True)} == left
    assert sum(x != y for (_, x), y in zip(whole, texts, strict=True)) > 0
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    sets = [s for s in decontaminate.item_shingles(items, 5) if len(s)]
    texts = decontaminate.item_shingles([r.text for r in rows["decontamination"]], 5)
    clean = {r.doc_id for r, t in zip(rows["decontamination"], texts, strict=True) if not any(len(np.intersect1d(s, t)) >= 0.8 * len(s) for s in sets)}
    assert clean == {r.doc_id for r in rows["packing"]} == {r.doc_id for r in rows["end"]}
    assert len(rows["decontamination"]) == len(kept)


def test_run_equals_stages(spark):
    """The whole run gives the rows of the stages called one after another, and leaves one folder behind."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    pieces = lambda rows: sorted((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = corpus_pipeline.run(spark, DIR).collect()
    assert pieces(found) == pieces(docs.collect()) and len(found) > 0
    assert [os.listdir(f"{folder}/{x}") for x in set(os.listdir(folder)) - before if x.startswith("pipeline-")] == [["decontamination"]]


def test_empty_and_odd_documents(spark):
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two", None, "s", 7), (3, "one two", None, "s", 7)], schema)
    for rows in (odd, odd.limit(0)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DIR)
            assert name == "packing" or out.columns == docs.columns
            docs = out
        assert {r.doc_id for r in docs.collect()} == ({3} if rows is odd else set())
