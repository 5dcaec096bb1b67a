"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products.

Unit vectors are assigned to the cell of the nearest centroid (largest cosine). Cosines are
computed within cells, a block of rows against a block of rows, in double precision. A vector
near a border is also compared in the ``PROBES`` - 1 next cells, against the vectors that live
there; links are found only where one of two vectors has the other's cell among its probes,
so recall is measured (see the tests) rather than certain.

Cells are made on two levels, so that their size does not grow with the table. At most
``COARSE`` centroids are fitted on a bounded sample. Where such a cell holds more than
``SPLIT`` times ``CELL`` vectors, tasks fit centroids of its own for each coarse cell, one for each
``CELL`` members, on a bounded sample of them; a vector then looks at the fine cells of its
nearest coarse cells and keeps the best few. Every vector is assigned and compared.

Equal vectors form one class with a multiplicity first, so copies never meet each other.
A cell of more than ``TILE`` classes is split: its rows are dealt into shares and each pair of
shares is one task's group, so that no task holds more than two shares.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Workspace, connected_components

MIN_COSINE = 0.95
#: The centroids of a level, or of one coarse cell, are fitted on about so many vectors at most.
MAX_SAMPLE = 20_000
#: Vectors that a cell should have, the cells that a vector is compared in, rows of a share.
CELL, PROBES, TILE, ROUNDS = 500, 3, 2048, 12
#: Most coarse cells, and times ``CELL`` that one may hold before coarse cells are parted; rows that
#: one task lays against a coarse cell's centroids, and the most such centroids.
COARSE, SPLIT, LOT, MAX_FINE = 2048, 4, 20_000, 4096


def unit(v) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it links with nothing."""
    if v is None or any(x is None for x in v):
        return None
    x = np.asarray(v, dtype=np.float64)
    if not len(x) or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top  # neither overflows nor vanishes when squared
    return x / math.sqrt(float(x @ x))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """``k`` or fewer unit centroids of the unit rows of ``x``."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1)
        full = size > 1e-12
        c = c.copy()
        c[full] = sums[full] / size[full, None]
    return c


def _linked(x: np.ndarray, y: np.ndarray, limit: float) -> np.ndarray:
    return x @ y.T >= limit


def _group(ids, home, probes, mult, x, cell, diagonal, share, limit):
    """Link counts of a group's rows, and a spanning forest of its links.

    ``share`` is 0 or 1: rows of one share meet those of the other, or each other if
    ``diagonal``. A pair is counted in the smaller of the cells in which it meets.
    """
    n = len(ids)
    counts = np.zeros(n, np.int64)
    label = np.arange(n)
    order = np.argsort(share, kind="stable")
    ids, home, probes, mult, x, share = ids[order], home[order], probes[order], mult[order], x[order], share[order]
    starts = range(0, n, 512)
    for a in starts:
        for b in starts:
            if b < a:
                continue
            near = _linked(x[a : a + 512], x[b : b + 512], limit)
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            ok = (i < j) & ((share[i] != share[j]) | diagonal)
            i, j = i[ok], j[ok]
            # one of the two lives here, and the pair has not met in a smaller cell
            here_i, here_j = home[i] == cell, home[j] == cell
            other = np.where(here_i, home[j], home[i])
            guest, host = np.where(here_i, j, i), np.where(here_i, i, j)
            both = here_i & here_j
            elsewhere = (probes[host] == home[guest][:, None]).any(1) & (other < cell)
            ok = both | ((here_i | here_j) & ~elsewhere)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            np.add.at(counts, i, mult[j])
            np.add.at(counts, j, mult[i])
            while True:
                p, q = label[i], label[j]
                if (p == q).all():
                    break
                np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
                while (label != label[label]).any():
                    label = label[label]
    return ids, counts, ids[label]


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE, cell: int = CELL, probes: int = PROBES, tile: int = TILE, max_sample: int = MAX_SAMPLE, coarse: int = COARSE) -> DataFrame:
    """(id, n_links, component_id, kept) of each row of ``vectors``.

    n_links counts the other rows linked directly, component_id is the least id reachable and
    kept tells whether it is the row's own. Vectors that are null, empty or zero, or that hold a
    null or a number that is not finite, link with nothing, nor do vectors of different
    lengths. Rows with null ids are counted as links, and are kept only if alone. An empty
    table gives an empty table. Other columns are left out.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "embeddings")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    valid = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("valid", valid)
    # a class is known by two hashes of its vector, and by a number once it is written
    h1, h2 = (F.when(F.col("valid"), F.xxhash64(*salt, "v")) for salt in ((), (F.lit(3),)))
    keyed = rows.withColumn("h1", h1).withColumn("h2", h2)
    classes = keyed.where("valid").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("mult"), F.first("v").alias("v"))
    classes = space.write(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    facts = classes.agg(F.count("*"), F.collect_set(F.size("v"))).first()
    if not facts[0]:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    centroids, base = {}, 0
    k = max(1, min(coarse, math.ceil(facts[0] / cell)))
    sample = [unit(v) for v in classes.orderBy("h1", "h2").limit(max_sample).select("v").toArrow()["v"].to_numpy()]
    for size in sorted(facts[1]):
        of = np.array([v for v in sample if len(v) == size])
        if len(of):
            centroids[size] = (base, spherical_kmeans(of, k))
        else:  # no vector of this length in the sample: one cell
            centroids[size] = (base, np.zeros((1, size)))
        base += len(centroids[size][1])
    # bounded: COARSE centroids for each length
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch in batches:
            vs = [unit(v) for v in batch.column(2).to_pylist()]
            near = []
            for v in vs:
                first, c = shared.value[len(v)]
                dots = c @ v
                m = min(probes, len(c))
                top = np.argpartition(-dots, m - 1)[:m]
                near.append((first + top[np.argsort(-dots[top], kind="stable")]).tolist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(near, pa.list_(pa.int32())), pa.array([v.tobytes() for v in vs], pa.binary())], names=["key", "mult", "probes", "v"])

    assigned = space.write(classes.select("key", "mult", "v").mapInArrow(assign, "key long, mult long, probes array<int>, v binary"), "assigned")
    homes = {r.cell: r.n for r in assigned.groupBy(F.col("probes")[0].alias("cell")).agg(F.count("*").alias("n")).collect()}  # a row for each coarse cell
    if max(homes.values()) > SPLIT * cell:
        assigned = _refined(space, assigned, homes, cell, probes, max_sample)
    spread = assigned.select("*", F.posexplode("probes").alias("rank", "cell"))
    sizes = spread.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("shares"))
    # a row for each cell; AQE broadcasts it while it is small
    dealt = spread.join(space.write(sizes, "sizes"), "cell").withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda o: F.struct(F.least(F.col("share"), o.cast("int")).alias("x"), F.greatest(F.col("share"), o.cast("int")).alias("y")))
    dealt = dealt.select("cell", "key", "mult", "probes", "v", "share", F.explode(tiles).alias("t")).select("*", F.xxhash64("cell", "t.x", "t.y").alias("tile")).select("tile", "cell", F.col("t.x").alias("x"), F.col("t.y").alias("y"), "key", "mult", "probes", "share", "v")

    def compare(table):
        at, x, y = table.column("cell")[0].as_py(), table.column("x")[0].as_py(), table.column("y")[0].as_py()
        raw = table.column("v").to_pylist()
        out = [[], [], []]
        widths = np.array([len(v) for v in raw])
        for width in np.unique(widths):  # one, as cells belong to a length
            of = np.flatnonzero(widths == width)
            part = table.take(pa.array(of))
            v = np.frombuffer(b"".join(raw[i] for i in of), np.float64).reshape(len(of), -1)
            near = part.column("probes").to_pylist()
            m = max(map(len, near))
            near = np.array([p + [-1] * (m - len(p)) for p in near])
            made = _group(part.column("key").to_numpy(), near[:, 0], near, part.column("mult").to_numpy(), v, at, x == y, part.column("share").to_numpy(), min_cosine)
            for column, values in zip(out, made):
                column.append(values)
        ids, counts, root = (np.concatenate(c) for c in out)
        some = counts > 0
        return pa.table({"key": ids[some], "n": counts[some], "root": root[some]})

    met = space.write(dealt.groupBy("cell", "x", "y", "tile").applyInArrow(compare, "key long, n long, root long"), "met")
    counts = met.groupBy("key").agg(F.sum("n").alias("n"))
    roots = space.write(connected_components(space, met.select("key", "root").where("key <> root")), "roots")
    # of a component the least id, by way of its classes
    of = space.write(classes.select("key", "h1", "h2", "least", "mult").join(roots.withColumnRenamed("node", "key"), "key", "left").join(counts, "key", "left"), "of")
    least = of.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    known = space.write(of.join(least, "root", "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id")), "known")
    out = keyed.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def _refined(space: Workspace, assigned: DataFrame, homes: dict[int, int], cell: int, probes: int, max_sample: int) -> DataFrame:
    """``assigned`` with the best fine cells of each vector's coarse cells as its probes.

    Each coarse cell's task fits a centroid for each ``cell`` members on about ``max_sample`` of
    them, at most ``MAX_FINE``: two levels suffice for COARSE * MAX_FINE * CELL vectors.
    """
    spark = space.spark
    rows, base = [], 0
    for c, n in sorted(homes.items()):
        k = min(MAX_FINE, math.ceil(n / cell))
        rows.append((c, base, k, min(1.0, max_sample / n), math.ceil(n / LOT) + 1))
        base += k
    cells = F.broadcast(spark.createDataFrame(rows, "coarse int, base long, k int, share double, lots int"))  # a row for each coarse cell
    place = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    sample = assigned.select(F.col("probes")[0].alias("coarse"), "key", "v").join(cells, "coarse").where(place < F.col("share"))

    def fit(table):
        x = np.stack([np.frombuffer(v) for v in table.column("v").to_pylist()])
        x = x[np.lexsort(x.T[:2])]  # the same whatever the order of rows
        c = spherical_kmeans(x, table.column("k")[0].as_py())
        return pa.table({"coarse": table.column("coarse")[:1].combine_chunks(), "m": pa.array([c.tobytes()], pa.binary())})

    fitted = space.write(sample.select("coarse", "k", "v").groupBy("coarse").applyInArrow(fit, "coarse int, m binary"), "fitted")
    # a coarse cell's rows meet its centroids in lots, each with a copy of them
    met = assigned.select("key", "v", F.explode("probes").alias("coarse")).join(cells, "coarse").withColumn("lot", F.pmod(F.xxhash64("key"), F.col("lots")).cast("int"))
    held = cells.join(fitted, "coarse").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).select("coarse", "lot", "m")

    def near(left, right):
        if not left.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64()), "cell": pa.array([], pa.int64())})
        raw = left.column("v").to_pylist()
        x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
        # a cell of whose members none was sampled is one fine cell
        c = np.frombuffer(right.column("m")[0].as_py(), np.float64).reshape(-1, x.shape[1]) if right.num_rows else np.zeros((1, x.shape[1]))
        m = min(probes, len(c))
        keys, first = left.column("key").to_numpy(), left.column("base")[0].as_py()
        out = []
        for i in range(0, len(x), 4096):
            dots = x[i : i + 4096] @ c.T
            top = np.argpartition(-dots, m - 1, axis=1)[:, :m]
            out.append((np.repeat(keys[i : i + 4096], m), np.take_along_axis(dots, top, 1).ravel(), first + top.ravel()))
        k, cosine, of = (np.concatenate(c) for c in zip(*out))
        return pa.table({"key": k, "cosine": cosine, "cell": of.astype(np.int64)})

    found = met.select("coarse", "lot", "key", "v", "base").groupBy("coarse", "lot").cogroup(held.groupBy("coarse", "lot")).applyInArrow(near, "key long, cosine double, cell long")
    best = found.groupBy("key").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "cell"))), lambda x: x["cell"]), 1, probes).alias("probes"))
    return space.write(assigned.drop("probes").join(best, "key").select("key", "mult", "probes", "v"), "refined")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
