"""Embedding near-duplicates against all cosines."""

import math
from pathlib import Path

import numpy as np
import pytest

from palimpsest.llm import embeddings as E

SF = Path("/root/testdata/sf0.1")


def brute(rows, limit=0.95):
    """{id: (n_links, component)} of (id, vector) rows with distinct ids."""
    valid = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float))) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in rows}
    for n, (i, x) in enumerate(valid):
        for j, y in valid[:n]:
            if len(x) == len(y) and x @ y >= limit:
                links[i].add(j)
                links[j].add(i)
    component = {}
    for i in sorted(links):
        todo = [i] if i not in component else []
        while todo:
            j = todo.pop()
            if j not in component:
                component[j] = i
                todo += links[j]
    return {i: (len(links[i]), component[i]) for i, _ in rows}


def run(spark, rows, **kw):
    out = E.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **kw).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out) and len(out) == len(rows)
    return {r.vec_id: (r.n_links, r.component_id) for r in out}


def cluster(rng, n, dim, spread=0.08):
    out = []
    while len(out) < n:
        c = rng.normal(size=dim)
        out += [c + spread * rng.normal(size=dim) * np.linalg.norm(c) / math.sqrt(dim) for _ in range(rng.integers(1, 6))]
    return [[float(np.float32(x)) for x in v] for v in out[:n]]


@pytest.mark.parametrize("kw", [{}, {"cell": 50, "tile": 16}, {"cell": 20, "probes": 4, "tile": 5}, {"cell": 10, "coarse": 2, "probes": 4}])
def test_links_with_copies_and_tiles(spark, kw):
    rng = np.random.default_rng(1)
    vectors = cluster(rng, 160, 16) + [[1.0] * 16] * 40 + [[2.0] * 16] * 7
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    got, want = run(spark, rows, **kw), brute(rows)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert found >= 0.99 * there and all(got[i][0] <= want[i][0] for i in want)
    if found == there:
        assert got == want


def test_what_links_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, None), (6, []), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, [1.0, 0.0]), (12, [3.0, 0.0]), (13, [-1.0, 0.0]), (14, [1.0, 0.0, 0.0]), (15, [1e-30, 0.0]), (16, [3e38, 1e30])]
    want = {i: (0, i) for i, _ in rows} | {i: (3, 11) for i in (11, 12, 15, 16)}
    assert run(spark, rows) == want
    assert run(spark, [(1, None)]) == {1: (0, 1)}
    assert E.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_repeated_rows_null_ids_and_other_columns(spark):
    rows = [(3, [1.0, 2.0], "a"), (3, [1.0, 2.0], "a"), (None, [1.0, 2.0], "b"), (None, [2.0, -1.0], "c")]
    out = E.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string")).collect()
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, [(3, 2, 3, True), (3, 2, 3, True), (None, 2, 3, False), (None, 0, None, True)]))


def test_work_a_row_does_not_grow(spark, monkeypatch):
    """With few coarse cells, ten times the rows meet about as many others each."""
    rng = np.random.default_rng(6)
    work = []
    compare = E._group
    for n in (600, 6000):
        vectors = cluster(rng, n, 16)
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
        spread = []
        write = E.Workspace.write

        def seen(self, df, name, *more):
            out = write(self, df, name, *more)
            if name in ("assigned", "refined"):
                spread.append(out)
            return out

        monkeypatch.setattr(E.Workspace, "write", seen)
        E.embedding_dedup(df, cell=20, coarse=4).count()
        monkeypatch.setattr(E.Workspace, "write", write)
        assert len(spread) == 2  # the coarse cells were parted
        cells = spread[-1].selectExpr("explode(probes) as cell").groupBy("cell").count().collect()
        homes = {r.cell: r.n for r in spread[-1].selectExpr("probes[0] as cell").groupBy("cell").agg({"*": "count"}).toDF("cell", "n").collect()}
        work.append(sum(r["count"] * homes.get(r.cell, 0) for r in cells) / n)
    assert work[1] < 2 * work[0] and compare is E._group


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("sf,coarse", [("sf0.01", 2048), ("sf0.1", 2048), ("sf0.1", 3)])
def test_recall_on_the_table(spark, sf, coarse):
    path = SF.parent / sf / "embeddings.parquet"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(str(path)).collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    want = near.sum() - len(rows)
    got = {r.vec_id: r.n_links for r in E.embedding_dedup(spark.read.parquet(str(path)), coarse=coarse, cell=E.CELL if coarse > 3 else 100).collect()}
    assert all(got[i] <= n - 1 for (i, _), n in zip(rows, near.sum(1)))
    assert sum(got.values()) >= 0.9 * want
