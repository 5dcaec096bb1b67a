"""Quality rules: rule statistics of whole texts, and an isolation forest over them.

The statistics of a text become ratios that do not depend on its length. An isolation forest
(Liu, Ting and Zhou, 2008) is grown on labelled good documents; its splits are drawn over the
range of all labelled documents, so that what lies outside the good ones' range falls into
empty branches near the root and has a short path. Every ``HOLD``th good row grows no tree;
the score's threshold is the one that best separates those from the labelled bad rows, a good
row lost counting as two bad ones kept. At most ``MAX_LABELLED`` rows are fitted on: one for
each of so many labelled ids, those with the smallest hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import documents, strings

#: Bound on the labelled rows that the forest and its threshold are fitted on.
MAX_LABELLED = 8192
#: Of the good rows, one in so many sets the threshold; with fewer than ``MIN_HELD`` such rows all do.
HOLD, MIN_HELD = 4, 30
TREES, SUBSAMPLE, SEED = 128, 256, 7
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

FEATURES = ["symbol_ratio", "repeat_ratio", "dup_line_ratio", "word_length", "upper_ratio", "mark_ratio", "letter_ratio", "distinct_ratio"]
_COUNTS = pa.struct([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
_LETTERS_UPPER = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def statistics(text: str) -> tuple[tuple[int, ...], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the forest's features."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at space, tab, line feed, vertical tab, form feed, return
    n = len(words)
    if not n:
        return (0, 0, 0, 0, 0), [0.0] * len(FEATURES)
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    chars = len(text) - blanks
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    dups = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    repeats = 0
    if n > 3:
        k = len(number)
        if k < 2_000_000:
            windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
        else:  # three numbers of this size do not fit 64 bits
            _, pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)
            windows = pairs[:-1] * k + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        again = np.zeros(n - 2, bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        covered[:-2] |= again
        covered[1:-1] |= again
        covered[2:] |= again
        repeats = int(covered.sum())
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if not text.islower() else 0
    marks = sum(map(text.count, "!?|"))
    digits = sum(map(text.count, "0123456789"))
    features = [symbols / n, repeats / n, dups / max(1, len(lines)), min(chars / n, 40.0), upper / chars, marks / n, 1 - (digits + symbols + marks) / chars, len(number) / n ** 0.9]
    return (n, chars, symbols, dups, repeats), features


@dataclass
class IsolationForest:
    """Trees as arrays: a node's feature (-1: leaf), split, children and, of leaves, path length."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    norm: float
    threshold: float

    @staticmethod
    def _expected(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    @classmethod
    def fit(cls, good: np.ndarray, every: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> IsolationForest:
        rng = np.random.default_rng(seed)
        low, high = every.min(0), every.max(0)
        depth = max(1, math.ceil(math.log2(max(2, min(subsample, len(good)))))) + 4
        grown = []
        for _ in range(trees):
            rows = good[rng.choice(len(good), min(subsample, len(good)), replace=False)]
            feature, split, left, right, path = [], [], [], [], []

            def grow(rows, lo, hi, d):
                at = len(feature)
                for column, x in ((feature, -1), (split, 0.0), (left, 0), (right, 0), (path, 0.0)):
                    column.append(x)
                wide = np.flatnonzero(hi > lo)
                if len(rows) <= 1 or d >= depth or not len(wide):
                    path[at] = d + cls._expected(len(rows))
                    return at
                f = int(rng.choice(wide))
                s = float(rng.uniform(lo[f], hi[f]))
                feature[at], split[at] = f, s
                below, above = hi.copy(), lo.copy()
                below[f] = above[f] = s
                left[at] = grow(rows[rows[:, f] <= s], lo, below, d + 1)
                right[at] = grow(rows[rows[:, f] > s], above, hi, d + 1)
                return at

            grow(rows, low.copy(), high.copy(), 0)
            grown.append(tuple(np.array(c) for c in (feature, split, left, right, path)))
        return cls(grown, cls._expected(min(subsample, len(good))) or 1.0, 2.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for what is isolated at once."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                at = np.where(inner, np.where(x[rows, f] <= split[at], left[at], right[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)

    def calibrate(self, good: np.ndarray, bad: np.ndarray) -> None:
        """The threshold with the least of twice the share of good above it plus that of bad below."""
        g, b = np.sort(self.score(good)), np.sort(self.score(bad))
        cuts = np.unique(np.concatenate([g, b]))
        cost = 2 * (1 - np.searchsorted(g, cuts, side="right") / len(g)) + np.searchsorted(b, cuts, side="right") / len(b)
        best = np.flatnonzero(cost <= cost.min() + 1e-12)[-1]
        # half way to the next score seen
        self.threshold = float(cuts[best] + (cuts[best + 1] - cuts[best]) / 2) if best + 1 < len(cuts) else float(cuts[best])


def fit_forest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> IsolationForest | None:
    """A forest with its threshold, or None if there is no labelled good or no labelled bad row.

    Of an id's labels the least counts, and of documents that share it the one with the least
    features; documents that fail the base rules teach nothing.
    """
    picked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def run(batches):
        for batch in batches:
            found = [statistics(t) for t in strings(batch.column(1))]
            keep = [i for i, (counts, _) in enumerate(found) if not base_failed(counts)]
            taken = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column(0).take(taken), batch.column(2).take(taken), pa.array([found[i][1] for i in keep], pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    # at most max_labelled rows, hence small enough to send
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    kind = labels.schema["doc_id"].dataType.simpleString()
    seen = chosen.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(run, f"doc_id {kind}, quality int, x array<double>")
    # an id may have any number of documents: one row of it
    rows = seen.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).select("r.*").collect()
    good = np.array([r.x for r in sorted(rows) if r.quality == 1])
    bad = np.array([r.x for r in sorted(rows) if r.quality == 0])
    if not len(good) or not len(bad):
        return None
    held = np.arange(len(good)) % HOLD == HOLD - 1
    if held.sum() < MIN_HELD:
        held[:] = False
    forest = IsolationForest.fit(good[~held], np.concatenate([good[~held], bad]))
    forest.calibrate(good[held] if held.any() else good, bad)
    return forest


def base_failed(counts: tuple[int, ...]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]


def quality_column(forest: IsolationForest | None):
    """A column function of a text: struct of the counts, base_failed, anomaly and kept."""
    kind = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,anomaly:double,kept:boolean>"

    @F.arrow_udf(kind)
    def judge(text: pa.Array) -> pa.Array:
        found = [statistics(t) for t in strings(text)]
        x = np.array([f for _, f in found], dtype=float).reshape(len(found), len(FEATURES))
        score = forest.score(x) if forest else np.zeros(len(found))
        limit = forest.threshold if forest else 2.0
        failed = [base_failed(c) for c, _ in found]
        columns = [pa.array([c[i] for c, _ in found], pa.int64()) for i in range(5)]
        columns += [pa.array(failed, pa.bool_()), pa.array(score), pa.array([not f and bool(s <= limit) for f, s in zip(failed, score)], pa.bool_())]
        return pa.StructArray.from_arrays(columns, names=[*(f.name for f in _COUNTS), "base_failed", "anomaly", "kept"])

    return judge


def judge_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_quality`` (see ``quality_column``).

    A null or wordless text has zero counts and fails the base rules. Without labelled rows of
    both kinds only the base rules decide. Rows, ids and other columns pass unchanged; a
    column named ``_quality`` is replaced.
    """
    forest = fit_forest(docs, labels, text_col=text_col)
    return docs.withColumn("_quality", quality_column(forest)(F.col(text_col).cast("string")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep."""
    forest = fit_forest(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_column(forest)(F.col("text").cast("string"))["kept"])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return judge_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "_quality.*")
