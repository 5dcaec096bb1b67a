"""SimHash fingerprints and components against brute force."""

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

from palimpsest.llm import simhash as S
from palimpsest.llm.common import Workspace

SF = Path("/root/testdata/sf0.001")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, max_bits=3):
    """{id: least id reachable} of (id, fingerprint) rows, all pairs."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if bin(a ^ b).count("1") <= max_bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_fingerprints():
    rng = random.Random(3)
    cases = ["", " \n", "One", "one two", "one two three", "É À a\x0bb c", "a a a a a", "A  b\tC d"]
    cases += [" ".join(rng.choices(["a", "B", "c", "d", "é"], k=rng.randrange(1, 900))) for _ in range(30)]
    for t in cases:
        assert S.fingerprint(t) == brute_fingerprint(t), t


def chains(rng, n):
    """Fingerprints with copies, near copies, chains of near copies and borderline distances."""
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5])):
            out.append(x)
            for b in rng.sample(range(64), rng.choice([0, 1, 3, 4])):
                x ^= 1 << b
    return out[:n]


def test_the_table_discards_and_loses_nothing():
    """Within one group: of all pairs few are met, of those almost none reach the exact check."""
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 1 << 64, 900, dtype=np.uint64)
    near = fps[:60] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
    fps = np.unique(np.concatenate([fps, near]))
    refs = S.pivots()
    fps = fps[np.lexsort((fps, np.bitwise_count(fps ^ refs[0])))]
    tally = [0, 0, 0]
    found = {(min(a, b), max(a, b)) for x, y in S._pairs(np.zeros(len(fps), np.int64), fps, 3, refs, tally) for a, b in zip(x.tolist(), y.tolist())}
    distance = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(distance <= 3)) if a < b} and len(found) >= 50
    every = len(fps) * (len(fps) - 1) // 2
    assert tally[0] < 0.6 * every and tally[1] < 0.001 * every and tally[2] == len(found)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("group", [4096, 6])
def test_components_equal_brute_force(spark, group):
    rng = random.Random(group)
    # many that share 40 bits fill the hot groups, which a small bound deals again
    base = rng.getrandbits(64)
    fps = chains(rng, 250) + [base ^ rng.getrandbits(10) << 50 for _ in range(120)] + [0] * 5
    rows = list(enumerate(fps, 10))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, signed(x)) for i, x in rows], "id long, fp long")
    out = S.fingerprint_components(Workspace(spark, "test-simhash"), df, group=group).collect()
    assert {r.id: r.component_id for r in out} == brute_components(rows)


def test_rows(spark):
    text = "some words that make a few shingles of three"
    rows = [(4, None, 1), (2, "", 2), (None, " \n", 3), (9, text, 4), (9, text, 4), (7, text.upper(), 5), (None, "only this one has no number", 6)]
    out = S.simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter({(4, 2): 1, (2, 2): 1, (None, 2): 1, (9, 7): 2, (7, 7): 1, (None, None): 1})
    assert S.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = "the same long text again " * 100_000
    out = S.simhash_components(spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string")).collect()
    assert {r.component_id for r in out} == {1} and out[0].fp == signed(S.fingerprint(long))


def test_stage_keeps_one_of_each_group(spark):
    text = "some words that make a few shingles of three"
    rows = [(9, text, "a"), (7, text, "b"), (3, "another text of a few more words", "c"), (None, text, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = S.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.component_id for r in out.collect()) == ["b", "c", "d"]  # a row without an id is never dropped


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(d.doc_id, brute_fingerprint(d.text or "")) for d in docs]
    want = brute_components(rows)
    out = S.op5_simhash_dedup(spark, str(SF)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {i: (f"{x:016x}", want[i]) for i, x in rows}
