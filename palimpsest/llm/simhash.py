"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles.
Fingerprints at Hamming distance ``MAX_BITS`` or less link. Equal fingerprints form one class
first, so copies never meet each other.

Each worker precomputes a table of the Hamming distances from its fingerprints to ``PIVOTS``
reference fingerprints. By the triangle inequality two fingerprints within d of each other
differ by at most d in every coordinate of the table. Rows are sorted by their first coordinate,
so that a row meets only those within d of it there; of these, pairs whose largest coordinate
difference is greater than d are discarded, and the survivors are verified exactly.

A pivot leaves about half of all unrelated pairs and all pivots together almost none, but to
deal rows to tasks by k coordinates would copy each about 1.75 ** k times for a factor of
0.46 ** k in pairs. Which rows come to one task is therefore limited, without loss, by the
pigeonhole principle: of 5 blocks of a fingerprint two must be equal in any pair within 3 bits.
Groups of equal blocks with more than ``GROUP`` classes are dealt again by
blocks of the bits that are still free, of which one must be equal, until a group is small or
has at most 2 ** 16 values. So no group that a task holds grows with the corpus.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import ASCII_LOWER, Workspace, connected_components, documents, strings

SHINGLE, MAX_BITS, SEED = 3, 3, 42
PIVOTS, GROUP, MAX_REFINE = 32, 4096, 3

_SPREAD = np.zeros(256, np.uint64)
for _b in range(8):
    _SPREAD |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_b)) & np.uint64(1)) << np.uint64(8 * _b)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    # eight counters of eight bits in a word: sums of 255 rows do not overflow
    lanes = _SPREAD[hashes.astype("<u8").view(np.uint8).reshape(n, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0).astype("<u8")
    counts = sums.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 of a text without words."""
    from xxhash import xxh64_intdigest as xxh

    words = text.translate(ASCII_LOWER).encode("utf-8", "surrogatepass") if not text.isascii() else text.lower().encode()
    words = words.split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh(b" ".join(words), seed)
    if shingle == 3:
        made = [xxh(b"%b %b %b" % w, seed) for w in zip(words, words[1:], words[2:])]
    else:
        made = [xxh(b" ".join(words[i : i + shingle]), seed) for i in range(len(words) - shingle + 1)]
    return majority(np.array(made, np.uint64))


def fingerprint_column(text):
    """The fingerprint of a text column as a signed 64-bit integer; null counts as empty."""

    @F.arrow_udf("bigint")
    def fingerprints(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t) for t in strings(text)], np.uint64).view(np.int64))

    return fingerprints(text.cast("string"))


def _blocks(bits: list[int], n: int) -> list[int]:
    """The masks of ``n`` about equal blocks of the given bits."""
    return [sum(1 << b for b in bits[i * len(bits) // n : (i + 1) * len(bits) // n]) for i in range(n)]


def _masks(max_bits: int) -> list[int]:
    blocks = _blocks(list(range(64)), max_bits + 2)
    return [a | b for a, b in combinations(blocks, 2)]


def _refined(mask: int, max_bits: int) -> list[int]:
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | b for b in _blocks(free, max_bits + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: independent uniform 64-bit numbers, the same in every task."""
    return np.random.default_rng(64).integers(0, 1 << 64, n, dtype=np.uint64)


def _pairs(keys: np.ndarray, fps: np.ndarray, max_bits: int, refs: np.ndarray, tally: list[int] | None = None):
    """Index pairs of equal keys within ``max_bits``, in runs; rows are sorted by key and then by
    their distance to the first reference.

    Rows are laid against the row ``gap`` further on, as long as that has the key and a first
    distance within ``max_bits``. ``tally`` takes up the pairs met, left by the table, and left
    by the exact check.
    """
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    first = table[:, 0]
    a = np.arange(len(keys) - 1)
    gap = 1
    while len(a):
        a = a[a + gap < len(keys)]
        # beyond the first row that is too far, all are
        a = a[(keys[a] == keys[a + gap]) & (first[a + gap] - first[a] <= max_bits)]
        left, right = a, a + gap
        met = len(left)
        for j in range(1, len(refs)):
            near = np.abs(table[left, j] - table[right, j]) <= max_bits
            left, right = left[near], right[near]
            if not len(left):
                break
        near = np.bitwise_count(fps[left] ^ fps[right]) <= max_bits
        if tally is not None:
            for i, n in enumerate((met, len(left), int(near.sum()))):
                tally[i] += n
        if near.any():
            yield left[near], right[near]
        gap += 1


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a and b: the least index of each group, as far as links are known."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def near_links(keyed: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS) -> DataFrame:
    """(a, b): links that connect what lies within ``max_bits`` in a group of equal ``key``.

    ``keyed`` has (key, fp), distinct, and is dealt and sorted by key; of a group's links a
    spanning forest is returned, no more rows than the group has.
    """

    def run(batches):
        refs = pivots(n_pivots)
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(keys, fps):
            order = np.lexsort((fps, np.bitwise_count(fps ^ refs[0]), keys))
            keys, fps = keys[order], fps[order]
            label = np.arange(len(keys))
            for a, b in _pairs(keys, fps, max_bits, refs):
                label = _join(label, a, b)
            far = np.flatnonzero(label != np.arange(len(keys)))
            return pa.record_batch([pa.array(fps[far].view(np.int64)), pa.array(fps[label[far]].view(np.int64))], names=["a", "b"])

        for batch in batches:
            held_k = np.concatenate([held_k, batch.column(0).to_numpy()])
            held_f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
            if not len(held_k) or held_k[0] == held_k[-1]:
                continue
            whole = int(np.searchsorted(held_k, held_k[-1]))  # the last group may go on
            yield links(held_k[:whole], held_f[:whole])
            held_k, held_f = held_k[whole:], held_f[whole:]
        if len(held_k):
            yield links(held_k, held_f)

    return keyed.select("key", "fp").mapInArrow(run, "a long, b long")


def _deal(space: Workspace, fps: DataFrame, max_bits: int, group: int) -> DataFrame:
    """(key, fp) rows in groups of a bounded size, in which every close pair meets."""

    def keys(masks: list[int]):
        return F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.xxhash64(F.lit(_signed(m)), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("key")) for m in masks])

    masks = _masks(max_bits)
    rows = fps.select("fp", F.explode(keys(masks)).alias("k")).select("k.mask", "k.key", "fp")
    kept = []
    for level in range(MAX_REFINE):
        sizes = rows.groupBy("mask", "key").count().where(F.col("count") > group)
        sizes = space.write(sizes, f"hot-{level}")
        if sizes.isEmpty():
            break
        kept.append(rows.join(sizes, ["mask", "key"], "left_anti"))
        hot = rows.join(sizes.drop("count"), ["mask", "key"])
        choose = F.lit(None)
        for m in masks:
            choose = F.when(F.col("mask") == _signed(m), keys(_refined(m, max_bits))).otherwise(choose)
        # the old key goes in too: rows of different hot groups need not meet again
        hot = hot.select("fp", F.col("key").alias("was"), F.explode(choose).alias("k"))
        rows = space.write(hot.select("k.mask", F.xxhash64("was", "k.key").alias("key"), "fp"), f"refined-{level}")
        masks = sorted({x for m in masks for x in _refined(m, max_bits)})
    kept.append(rows)
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.select("key", "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """(id, fp, component_id) of each row of ``docs``: the least id among all that links reach.

    Texts without words (null and empty ones too) have fingerprint 0 and link like any other.
    Null ids are never a component's id unless it has no other; rows that share an id each
    come back. Other columns are left out. An empty table gives an empty table.
    """
    space = Workspace(docs.sparkSession, "simhash")
    rows = docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp"))
    return fingerprint_components(space, rows, max_bits, group).withColumnRenamed("id", id_col)


def fingerprint_components(space: Workspace, rows: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """(id, fp, component_id) of rows (id, fp); see ``simhash_components``."""
    rows = space.write(rows, "rows")
    classes = space.write(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    dealt = _deal(space, classes.select("fp"), max_bits, group)
    links = near_links(dealt.repartition("key").sortWithinPartitions("key"), max_bits)
    roots = space.write(connected_components(space, space.write(links.distinct(), "links")), "roots")
    linked = roots.withColumnRenamed("node", "fp").join(classes, "fp")
    least = space.write(linked.groupBy("root").agg(F.min("least").alias("component")), "least")
    linked = space.write(roots.join(least, "root").select(F.col("node").alias("fp"), "component"), "components")
    known = space.write(classes.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "known")
    return rows.join(known, "fp").select("id", "fp", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the document with the least id.

    Rows that share that id all stay, as do rows without an id.
    """
    found = simhash_components(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
