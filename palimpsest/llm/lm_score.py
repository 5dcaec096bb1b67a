"""Document likelihood by a lattice of subword segmentations.

A word, with a mark before it, is a lattice whose arcs are the pieces of an existing
vocabulary. Its probability is the sum over all segmentations, by a forward recursion in log
space. A segmentation is a first piece (one that starts with the mark), then for each further
piece a decision to go on and the piece, then the decision to stop. A text is a sequence of
words and one end; each token is the end with the share that ends have among the training
tokens. So a text's probability is the product of its words' marginals and these decisions, and
nothing but the lattice scores a word, known or new.

The vocabulary's own scores weigh the pieces: a unigram vocabulary's are log probabilities, a
merge vocabulary's are ranks, of which r weighs 1 / (r + 20). The training words' expected counts
of pieces, over all segmentations and all tokens, are added to these weights as to a prior of
``PRIOR`` pieces, ``ROUNDS`` times.

Word counts and piece counts cover the whole corpus and are aggregated in the cluster. The
at most ``HOT`` most frequent words are sent to the workers; the rest meet their counts in a
join on the word, so no table that grows with the corpus is broadcast.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import ASCII_LOWER, Workspace, documents, strings

MARK, ROUNDS, HOT, PRIOR, SMOOTH = "▁", 1, 131_072, 2000.0, 0.1
#: Distinct words that a task counts before it passes its counts on.
FLUSH = 400_000
LN10 = math.log(10)


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case, as UTF-8."""
    return (text.lower().encode() if text.isascii() else text.translate(ASCII_LOWER).encode("utf-8", "surrogatepass")).split()


#: Bits of the table that most strings which are no piece fail to pass.
SLOTS = 20


def _roll(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings from those of the strings without their last characters."""
    return (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + codes + np.uint64(1)


def _slot(h: np.ndarray) -> np.ndarray:
    return h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - SLOTS)


def _hashes(pieces: list[str]) -> np.ndarray:
    h = np.zeros(len(pieces), np.uint64)
    for k in range(max(map(len, pieces))):
        at = np.array([i for i, p in enumerate(pieces) if len(p) > k])
        h[at] = _roll(h[at], np.array([ord(pieces[i][k]) for i in at], np.uint64))
    return h


class Lattice:
    """Pieces with natural-log weights; index ``unknown`` stands for a character without piece."""

    def __init__(self, model_path: str, weights: np.ndarray | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        self.unknown = size
        skip = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        self.pieces = {sp.id_to_piece(i): i for i in range(size) if not skip[i]}
        self.longest = max(map(len, self.pieces))
        hashes = _hashes(list(self.pieces))
        order = np.argsort(hashes)
        self.hashes, self.hashed = hashes[order], np.array(list(self.pieces.values()), np.int32)[order]
        self.present = np.zeros(1 << SLOTS, bool)
        self.present[_slot(hashes)] = True
        self.initial = np.zeros(size + 1, bool)
        for p, i in self.pieces.items():
            self.initial[i] = p[0] == MARK
        used = sorted(self.pieces.values())
        score = np.array([sp.get_score(i) for i in used])
        self.start = np.zeros(size + 1)
        # ranks are whole numbers down from 0; log probabilities are not
        ranks = bool((score == np.round(score)).all())
        self.start[used] = 1 / (20 - score) if ranks else np.exp(score)
        self.start[size] = self.start[used].min()
        self.weights = self.estimate(np.zeros(size + 1), 0.0) if weights is None else weights

    def estimate(self, counts: np.ndarray, words: float) -> np.ndarray:
        """Log weights (of each piece, then of going on is in each; last: stop) from counts."""
        out = np.full(len(counts) + 1, -np.inf)
        first = self.initial
        of = self.start > 0
        a, b = first & of, ~first & of
        prior = np.zeros(len(counts))
        prior[a] = PRIOR * self.start[a] / self.start[a].sum()
        prior[b] = PRIOR * self.start[b] / self.start[b].sum()
        c = counts + prior
        out[:-1][a] = np.log(c[a] / c[a].sum())
        stop = words + PRIOR / 2
        out[:-1][b] = np.log(c[b] / (c[b].sum() + stop))
        out[-1] = math.log(stop / (c[b].sum() + stop))
        return out

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, log weights) by length - 1, start and word; words are marked and of one length.

        Pieces are looked up by 64-bit hashes of their code points, all words at a time.
        """
        n, m = len(words[0]), min(self.longest, len(words[0]))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
        codes = np.ascontiguousarray(codes.T).astype(np.uint64)
        ids = np.full((m, n, len(words)), -1, np.int32)
        h = np.zeros_like(codes)
        for k in range(1, m + 1):
            h = _roll(h[: n - k + 1], codes[k - 1 :])
            i, w = np.nonzero(self.present[_slot(h)])
            found = h[i, w]
            at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            hit = self.hashes[at] == found
            ids[k - 1, i[hit], w[hit]] = self.hashed[at[hit]]
        lp = np.where(ids >= 0, self.weights[ids], -np.inf)
        alone = ids[0] < 0
        if alone.any():
            size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)  # of UTF-8
            ids[0][alone] = self.unknown
            lp[0][alone] = self.weights[self.unknown] - size[alone] * math.log(256)
        return ids, lp

    @staticmethod
    def _sum(x: np.ndarray) -> np.ndarray:
        top = x.max(0)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return safe + np.log(np.exp(x - safe).sum(0))

    def forward(self, lp: np.ndarray) -> np.ndarray:
        """Log sums over the segmentations of each word's first 0, 1, ... characters."""
        m, n, w = lp.shape
        alpha = np.full((n + 1, w), -np.inf)
        alpha[0] = 0
        for j in range(1, n + 1):
            ks = np.arange(1, min(m, j) + 1)
            alpha[j] = self._sum(alpha[j - ks] + lp[ks - 1, j - ks])
        return alpha

    def backward(self, lp: np.ndarray) -> np.ndarray:
        """Log sums over the segmentations of what follows each place."""
        m, n, w = lp.shape
        beta = np.full((n + 1, w), -np.inf)
        beta[n] = 0
        for i in range(n - 1, -1, -1):
            ks = np.arange(1, min(m, n - i) + 1)
            beta[i] = self._sum(beta[i + ks] + lp[ks - 1, i])
        return beta

    def _grouped(self, words: list[str]):
        """Indices of words of one length, in lots of a bounded number of cells."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for n, at in by.items():
            lot = max(1, 2_000_000 // (n * min(n, self.longest)))
            for k in range(0, len(at), lot):
                yield at[k : k + lot]

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability, over all its segmentations."""
        out = np.empty(len(words))
        for at in self._grouped(words):
            _, lp = self.arcs([MARK + words[i] for i in at])
            out[at] = self.forward(lp)[-1] + self.weights[-1]
        return out

    def expected(self, words: list[str], weight: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over the words' segmentations."""
        counts = np.zeros(self.unknown + 1)
        for at in self._grouped(words):
            ids, lp = self.arcs([MARK + words[i] for i in at])
            alpha, beta = self.forward(lp), self.backward(lp)
            k, i, w = np.nonzero(ids >= 0)
            with np.errstate(invalid="ignore"):
                post = np.exp(alpha[i, w] + lp[k, i, w] + beta[i + k + 1, w] - alpha[-1, w])
            counts += np.bincount(ids[k, i, w], np.nan_to_num(post) * weight[at][w], self.unknown + 1)
        return counts


_lattices: dict[tuple, Lattice] = {}


def lattice(model_path: str, weights: np.ndarray | None = None) -> Lattice:
    key = (model_path, None if weights is None else hash(weights.tobytes()))
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattice(model_path, weights)
    return _lattices[key]


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept out of learning: crc32 of its id as text, mod 10, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def word_counts(docs: DataFrame, text_col: str, train) -> DataFrame:
    """(word binary, c): how often each word of any document occurs in those with ``train``."""

    def run(batches):
        seen: Counter = Counter()
        others: set = set()

        def rows():
            words = [*seen, *(others - seen.keys())]
            return pa.record_batch([pa.array(words, pa.binary()), pa.array([seen.get(w, 0) for w in words], pa.int64())], names=["word", "c"])

        for batch in batches:
            for learn, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                (seen if learn else others).update(words_of(text))
                if len(seen) + len(others) > FLUSH:
                    yield rows()
                    seen.clear()
                    others.clear()
        yield rows()

    return docs.select(train.alias("train"), F.col(text_col).cast("string")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def lattice_score(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Tokens are the words and one end. Null and wordless texts are the end alone. base_score is
    the smoothed unigram score, score the lattice's, both log10. Rows that share an id each
    come back; a null id is not held out. Without training tokens the lattice rests on the
    vocabulary's own scores and a token is the end by half. Other columns are left out. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "lm-score")
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counts = space.write(word_counts(rows, "text", ~F.col("held_out")), "counts")
    ends = rows.where(~F.col("held_out")).count()
    facts = counts.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    n = (facts[0] or 0) + ends
    distinct = facts[1] + (ends > 0)
    # a token is the end with this probability; half a token of each kind is added
    end = (ends + 0.5) / (n + 1)
    base_of = n + SMOOTH * (distinct + 1)

    weights = lattice(model_path).weights
    for _ in range(rounds if n else 0):
        weights = _estimate(counts, model_path, weights)
    shared = spark.sparkContext.broadcast(weights)  # one number for each piece of the vocabulary

    def score(batches):
        net = lattice(model_path, shared.value)
        for batch in batches:
            words = [w.decode("utf-8", "surrogatepass") for w in batch.column(0).to_pylist()]
            p = (math.log(1 - end) + net.log_probability(words)) / LN10
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(p)], names=["word", "c", "p"])

    model = space.write(counts.mapInArrow(score, "word binary, c long, p double"), "model")
    # a word is hot from a count on that at most `hot` words reach
    steps = sorted(((r.step, r.n) for r in counts.where("c > 0").groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for step, k in steps:
        total += k
        if total > hot:
            break
        least = step
    is_hot = F.coalesce((F.col("c") > 0) & (F.floor(F.log2("c") * 8) >= least), F.lit(False)) if least is not None else F.lit(False)
    few = model.where(is_hot).toArrow()
    table = spark.sparkContext.broadcast((few["word"].to_pylist(), few["c"].to_numpy(), few["p"].to_numpy()))  # at most `hot` rows
    end_p = math.log10(end)
    end_base = math.log10((ends + SMOOTH) / base_of)

    def read(batches):
        words, c, p = table.value
        known = dict(zip(words, zip((np.log10((c + SMOOTH) / base_of)).tolist(), p.tolist())))
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in strings(batch.column(2)):
                found = words_of(text)
                base, prob, hits, rare, times = end_base, end_p, int(ends > 0), [], []
                for w, k in Counter(found).items():
                    if (e := known.get(w)) is None:
                        rare.append(w)
                        times.append(k)
                    else:
                        base += k * e[0]
                        prob += k * e[1]
                        hits += k
                for column, x in zip(out, (len(found) + 1, hits, base, prob, rare, times)):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(out, kinds))], names=["id", "held_out", "n_tokens", "hits", "base", "prob", "rare", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    read_rows = rows.mapInArrow(read, f"id {kind}, held_out boolean, n_tokens long, hits long, base double, prob double, rare array<binary>, times array<int>")
    # written once, so that the row numbers stay
    read_rows = space.write(read_rows.withColumn("row", F.monotonically_increasing_id()), "read")
    pairs = read_rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    met = pairs.join(model.where(~is_hot), "word")
    more = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more_hits"),
        F.sum(F.col("k") * F.log10((F.col("c") + SMOOTH) / F.lit(base_of))).alias("more_base"),
        F.sum(F.col("k") * F.col("p")).alias("more_prob"),
    )
    out = read_rows.drop("rare", "times").join(space.write(more, "more"), "row", "left")

    def plus(a: str, b: str):
        return F.col(a) + F.coalesce(F.col(b), F.lit(0))

    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", plus("hits", "more_hits").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("prob", "more_prob").alias("score"))


def _estimate(counts: DataFrame, model_path: str, weights: np.ndarray) -> np.ndarray:
    """Weights from one round of expected counts over all training tokens."""
    shared = counts.sparkSession.sparkContext.broadcast(weights)

    def expect(batches):
        net = lattice(model_path, shared.value)
        total, words = np.zeros(net.unknown + 1), 0.0
        for batch in batches:
            found = [w.decode("utf-8", "surrogatepass") for w in batch.column(0).to_pylist()]
            times = batch.column(1).to_numpy().astype(float)
            total += net.expected(found, times)
            words += times.sum()
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array([-1, *some.tolist()], pa.int32()), pa.array([float(words), *total[some].tolist()])], names=["piece", "n"])

    found = counts.where("c > 0").select("word", "c").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    net = lattice(model_path)
    total = np.zeros(net.unknown + 1)
    words = 0.0
    for r in found:  # a row for each piece
        if r.piece < 0:
            words = r.n
        else:
            total[r.piece] = r.n
    return net.estimate(total, words)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice_score(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
