"""Lattice likelihood: forward recursion against listed segmentations, scores against plain sums."""

import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from palimpsest.llm import lm_score as M

SF = Path("/root/testdata/sf0.001")
PATH = public_tokenizers.path("piece_bpe_32k.model")
NET = M.Lattice(PATH)


def segmentations(word):
    """Every way to cut a marked word into pieces; a character without piece stands alone."""
    if not word:
        yield []
        return
    for k in range(1, min(NET.longest, len(word)) + 1):
        i = NET.pieces.get(word[:k], -1)
        if i < 0 and k == 1:
            i = NET.unknown
        if i >= 0:
            for rest in segmentations(word[k:]):
                yield [(i, word[:k])] + rest


def log_of(seg):
    out = NET.weights[-1]
    for i, p in seg:
        out += NET.weights[i] - (len(p.encode()) * math.log(256) if i == NET.unknown else 0)
    return out


WORDS = ["a", "cat", "the", "internation", "été", "x1y2", "日本", "☃a", "qqq", "▁"]


def test_forward_sums_all_segmentations():
    got = NET.log_probability(WORDS)
    for w, x in zip(WORDS, got):
        every = [log_of(s) for s in segmentations(M.MARK + w)]
        top = max(every)
        assert x == pytest.approx(top + math.log(sum(math.exp(e - top) for e in every)), abs=1e-9) if math.isfinite(top) else x == top


def test_expected_counts_weigh_all_segmentations():
    words, weight = ["cat", "étés", "then"], np.array([1.0, 2.0, 0.5])
    want = np.zeros(NET.unknown + 1)
    for w, k in zip(words, weight):
        segs = list(segmentations(M.MARK + w))
        p = np.exp([log_of(s) for s in segs])
        for s, q in zip(segs, p / p.sum()):
            for i, _ in s:
                want[i] += k * q
    assert NET.expected(words, weight) == pytest.approx(want, abs=1e-9)


def test_weights_are_a_distribution():
    w = NET.weights
    first = NET.initial & (NET.start > 0)
    later = ~NET.initial & (NET.start > 0)
    assert np.exp(w[:-1][first]).sum() == pytest.approx(1)
    assert np.exp(w[:-1][later]).sum() + math.exp(w[-1]) == pytest.approx(1)


def words(text):
    return [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def base(rows):
    """{id: (held_out, n_tokens, n_known, N, base_score)} by plain counting; distinct ids."""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter()
    for i, t in rows:
        if not held[i]:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        toks = [*words(t), None]
        out[i] = (held[i], len(toks), sum(c[x] > 0 for x in toks), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in toks))
    return out


def compare(got, want):
    assert len(got) == len(want)
    for r in got:
        h, n, k, total, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, k, total)
        assert r.base_score == pytest.approx(score, rel=1e-9, abs=1e-9)
        assert math.isfinite(r.score) and r.score <= 0


ROWS = [(i, f"Some words {i % 7} of a text, été {'x' * (i % 5)} ☃ word{i}") for i in range(60)] + [(100, None), (101, ""), (102, " \n"), (103, "long text once " * 100_000)]


@pytest.mark.parametrize("hot", [100_000, 3, 0])
def test_base_scores_and_hot_words(spark, hot):
    """Words that meet their counts in a join score like those that are sent to the workers."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    out = M.lattice_score(docs, PATH, hot=hot).collect()
    compare(out, base(ROWS))
    every = {r.doc_id: r.score for r in M.lattice_score(docs, PATH).collect()}
    assert all(r.score == pytest.approx(every[r.doc_id], rel=1e-9) for r in out)


def plain_score(rows, rounds):
    """{id: score} by listing every segmentation of every word, counts and weights in dictionaries."""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter(w.decode() for i, t in rows if not held[i] for w in words(t))
    ends = sum(not h for h in held.values())
    n = sum(c.values()) + ends
    weights = NET.weights

    def weigh(seg):
        return math.exp(weights[-1] + sum(weights[i] - (len(p.encode()) * math.log(256) if i == NET.unknown else 0) for i, p in seg))

    for _ in range(rounds):
        counts = Counter()
        for w, k in c.items():
            segs = [(s, weigh(s)) for s in segmentations(M.MARK + w)]
            total = sum(p for _, p in segs)
            for s, p in segs:
                for i, _ in s:
                    counts[i] += k * p / total
        out = np.full(len(weights), -np.inf)
        used = [i for i in range(NET.unknown + 1) if NET.start[i] > 0]
        for starts in (True, False):
            of = [i for i in used if NET.initial[i] == starts]
            mass = sum(NET.start[i] for i in of)
            got = {i: counts[i] + M.PRIOR * NET.start[i] / mass for i in of}
            stop = 0 if starts else sum(c.values()) + M.PRIOR / 2
            for i in of:
                out[i] = math.log(got[i] / (sum(got.values()) + stop))
            if not starts:
                out[-1] = math.log(stop / (sum(got.values()) + stop))
        weights = out
    end = (ends + 0.5) / (n + 1)
    return {i: math.log10(end) + sum(math.log10(1 - end) + math.log10(sum(weigh(s) for s in segmentations(M.MARK + w.decode()))) for w in words(t)) for i, t in rows}


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_scores_equal_listed_segmentations(spark, rounds):
    rows = [(i, f"alpha beta alpha gam{'ma' * (i % 3)} Été") for i in range(1, 25)] + [(30, "alpha delta"), (31, None), (32, "new words")]
    assert len({zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}) == 2
    got = {r.doc_id: r.score for r in M.lattice_score(spark.createDataFrame(rows, "doc_id long, text string"), PATH, rounds=rounds).collect()}
    want = plain_score(rows, rounds)
    assert got == {i: pytest.approx(want[i], rel=1e-9) for i, _ in rows}


def test_rows(spark):
    rows = [(3, "same text", 1), (3, "same text", 1), (None, "other text", 2), (4, None, 3)]
    out = M.lattice_score(spark.createDataFrame(rows, "doc_id long, text string, row int"), PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == [("3", 3), ("3", 3), ("4", 1), ("None", 3)]
    assert M.lattice_score(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = M.lattice_score(spark.createDataFrame([(alone, "nothing was learned")], "doc_id long, text string"), PATH).collect()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) and math.isfinite(r.base_score)


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_query_and_held_out_gain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = M.op9_lm_score(spark, str(SF)).collect()
    compare(out, base(rows))
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -8
