"""The pipeline's stages against plain Python over the same rows, and its edge cases."""

from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline as C
from palimpsest.llm import language_id, packing, quality, queries, simhash

SF = Path("/root/testdata/sf0.001")


def test_registered():
    assert [name for name, _ in C.STAGES] == ["language_id", "quality_rules", "line_dedup", "simhash_dedup", "best_fit_packing"]
    found = entry.queries()
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(found) and C.ORACLE_SQL is None


def dedup_lines(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    owners = defaultdict(set)
    for i, t in docs.items():
        for x in t.split("\n"):
            owners[key(x)].add(i)
    return {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or min(owners[key(x)]) == i) for i, t in docs.items()}


def one_of_each_group(docs):
    fps = {i: simhash.fingerprint(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: t for i, t in docs.items() if find(i) == i}


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r.text or "" for r in table.collect()}
    model = language_id.fit_languages(table.where(~language_id.held_out()))
    known = {i: model.predict(t) for i, t in docs.items()}
    docs = {i: t for i, t in docs.items() if known[i][0] != "und" and known[i][1] >= language_id.MIN_SCORE}
    forest = quality.fit_forest(table.where(table.doc_id.isin(list(docs))), spark.read.parquet(f"{SF}/labels.parquet"))
    judged = {i: quality.statistics(t) for i, t in docs.items()}
    docs = {i: t for i, t in docs.items() if not quality.base_failed(judged[i][0]) and forest.score(np.array([judged[i][1]]))[0] <= forest.threshold}
    docs = one_of_each_group(dedup_lines(docs))
    tok = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(tok.encode(t)) // 4 + 1 for i, t in docs.items()}
    got, places = defaultdict(int), defaultdict(list)
    for r in C.run(spark, str(SF)).collect():
        got[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert got == tokens
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(tokens.values()) // 1024) * 1.02


def test_stages_take_odd_rows(spark, tmp_path):
    text = "These are some words of a clean English text, number {}. " + " ".join(f"word{i} and other{i}" for i in range(40))
    rows = [(i, text.format(i), "en", "s", 1) for i in range(6)] + [(6, None, None, None, None), (7, "", "en", "s", 0), (None, text.format("none"), None, "s", 1), (3, text.format(3), "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in C.STAGES:
            out = stage(spark, docs, str(tmp_path))
            path = str(tmp_path / f"{name}-{len(some)}")
            out.write.parquet(path)
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == bool(some)
