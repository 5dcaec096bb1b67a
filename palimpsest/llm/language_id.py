"""Hierarchical language identification with linear support vector machines.

The language family is predicted first, by one-versus-rest machines over all families; then
one-versus-one machines tell the languages of that family apart. Features are the relative
frequencies of the text's character 1- to 4-grams, hashed; letters (Unicode category L) in
lower case and their combining marks (M) count, everything else is one blank. Margins become
probabilities by Platt's sigmoid. A family of more than ``MAX_FAMILY`` languages, such as
that of all languages without a known family, is parted by the likeness of their mean
features, so that machines are few for each language, however many languages there are.

The machines are fitted on ``SAMPLE`` labelled texts of each language, or fewer if there are
many languages: at most ``MAX_ROWS`` rows, or ``MIN_SAMPLE`` a language, in all, and of each row
the ``MAX_FEATURES`` most frequent features. No language is left out. Copies of a text count as
one, and a row is chosen by its text's hash. Workers turn texts into sparse features, so no
text is collected, and tasks fit the machines side by side.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import documents, strings

#: Labelled texts of a language that the machines are fitted on; rows in all, but at least so
#: many of each language; features of a row.
SAMPLE, MAX_ROWS, MIN_SAMPLE, MAX_FEATURES = 500, 8192, 20, 8192
#: Languages that one-versus-one machines tell apart; machines that a text meets all at once.
MAX_FAMILY, AT_ONCE = 12, 64
ORDERS, BITS = 4, 14
#: Frequencies are multiplied by this for the machines.
SCALE = 20.0
UNKNOWN = "und"
#: The pipeline drops documents whose prediction is less sure than this.
MIN_SCORE = 0.2

_FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es pt it ro ca gl oc la ast",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu se",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk ky uz tk tt ug",
    "semitic": "ar he am mt ti",
    "indic": "hi bn ur mr gu pa ne si or as sd sa",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms jv su tl ceb mg mi",
    "sinitic": "zh yue wuu",
    "bantu": "sw zu xh sn rw",
}
FAMILY = {code: name for name, codes in _FAMILIES.items() for code in codes.split()}


def _others(upto: int) -> re.Pattern:
    """Runs of characters that are neither letters nor marks; of those before ``upto``."""
    kept = (c for c in range(upto) if unicodedata.category(chr(c))[0] in "LM")
    runs = [[c for _, c in run] for _, run in groupby(enumerate(kept), lambda p: p[1] - p[0])]
    return re.compile("[^" + "".join(f"{re.escape(chr(r[0]))}-{re.escape(chr(r[-1]))}" for r in runs) + "]+")


_NO_LETTERS, _NO_LATIN_LETTERS = _others(0x110000), _others(0x100)


def letters(text: str) -> str:
    """The text in lower case, with one blank for all that stands between letters and marks."""
    low = text.lower()
    try:
        low.encode("latin-1")
    except UnicodeEncodeError:
        return _NO_LETTERS.sub(" ", low)
    return _NO_LATIN_LETTERS.sub(" ", low)  # a small set of characters is matched faster


def family_of(lang: str) -> str:
    """The family of a language code (its part before "-" or "_"); "other" if it isn't listed."""
    return FAMILY.get(re.split("[-_]", lang.lower())[0], "other")


def grams(text: str) -> list[np.ndarray] | None:
    """Hashed n-grams for each order, each order in a range of its own; None without letters."""
    plain = letters(text).strip(" ")
    if not any(map(str.isalpha, plain)):  # marks alone are no letters
        return None
    codes = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out, g = [], codes
    for k in range(1, ORDERS + 1):
        if k > 1:
            if len(codes) < k:
                break
            g = g[:-1] * np.uint32(0x01000193) ^ codes[k - 1 :]
        out.append(((g * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)) + np.uint32((k - 1) << BITS)).astype(np.int32))
    return out


def sparse(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(feature, value) of a text: each order's relative frequencies."""
    found = grams(text)
    if found is None:
        return None
    ids, values = [], []
    for g in found:
        i, n = np.unique(g, return_counts=True)
        ids.append(i)
        values.append(n / len(g))
    return np.concatenate(ids), np.concatenate(values)


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, epochs: int = 30, c: float = 10.0, seed: int = 5) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, a, b): L2-regularised hinge loss by dual coordinate descent (Hsieh et
    al., 2008), classes weighted alike, and Platt's P(y = 1) = 1 / (1 + exp(a * margin + b))."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(size), 0.0
    norm = np.array([float(v @ v) + 0.01 for _, v in rows])
    bound = np.where(y > 0, c * len(y) / 2 / max(1, (y > 0).sum()), c * len(y) / 2 / max(1, (y < 0).sum()))
    alpha = np.zeros(len(rows))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            ids, v = rows[i]
            g = y[i] * (float(w[ids] @ v) + 0.1 * bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), bound[i])
            if d := new - alpha[i]:
                w[ids] += d * y[i] * v
                bias += 0.1 * d * y[i]
                alpha[i] = new
                moved = max(moved, abs(g))
        if moved < 1e-3:
            break
    bias *= 0.1
    m = np.array([float(w[ids] @ v) + bias for ids, v in rows])
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = -2.0, 0.0
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(np.clip(a * m + b, -500, 500)))
        d, h = t - p, p * (1 - p) + 1e-9
        ga, gb = float(d @ m), float(d.sum())
        haa, hab, hbb = float(h @ (m * m)) + 1e-6, float(h @ m), float(h.sum()) + 1e-6
        det = haa * hbb - hab * hab
        a, b = a - min(max((hbb * ga - hab * gb) / det, -5), 5), b - min(max((haa * gb - hab * ga) / det, -5), 5)
    return w, bias, min(a, -1e-3), b


@dataclass
class LanguageModel:
    """Weights of the machines; ``families`` maps a family to its languages.

    ``column`` numbers the machines: those of the families come first, then each family's
    pairs. ``blocks`` has the weights of all of them side by side if they are few, else those
    of the families and then of each family's pairs.
    """

    families: dict[str, list[str]]
    column: dict[tuple[str, ...], int]
    blocks: list[np.ndarray]
    bias: np.ndarray
    platt: np.ndarray

    def _margins(self, found: list[np.ndarray], block: int) -> np.ndarray:
        weights = self.blocks[block]
        margin = np.zeros(weights.shape[1])
        for g in found:
            # a long text's n-grams in runs, so that memory does not grow with it
            for i in range(0, len(g), 1 << 16):
                margin += weights.take(g[i : i + (1 << 16)], axis=0).sum(0, dtype=np.float64) / len(g)
        return margin

    def _sure(self, margin: np.ndarray, first: int) -> np.ndarray:
        at = slice(first, first + len(margin))
        return 1 / (1 + np.exp(np.clip(self.platt[at, 0] * (margin + self.bias[at]) + self.platt[at, 1], -500, 500)))

    def predict(self, text: str) -> tuple[str, float]:
        """(language, score); ``UNKNOWN`` and 0 if there are no letters or nothing was learned.

        The family with the largest probability wins, the first in the list of equals. Within
        it the language with the most votes wins, of equals the one with the larger sum of
        probabilities, then the first in the alphabet. ``score`` is the product of the
        family's share of the probabilities and the language's mean against the others.
        """
        found = grams(text) if self.families else None
        if found is None:
            return UNKNOWN, 0.0
        p = self._sure(self._margins(found, 0), 0)
        names = list(self.families)
        sure = np.array([p[self.column[f,]] if (f,) in self.column else 1.0 for f in names])
        sure = sure / max(float(sure.sum()), 1e-300)
        best = int(sure.argmax())
        langs = self.families[names[best]]
        votes, total = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        pairs = list(combinations(langs, 2))
        first = 0
        if pairs and len(self.blocks) > 1:
            first = self.column[pairs[0]]
            p = self._sure(self._margins(found, 1 + best), first)
        for x, y in pairs:
            q = float(p[self.column[x, y] - first])
            votes[x if q >= 0.5 else y] += 1
            total[x] += q
            total[y] += 1 - q
        lang = max(langs, key=lambda x: (votes[x], total[x]))
        within = total[lang] / (len(langs) - 1) if len(langs) > 1 else 1.0
        return lang, min(1.0, max(0.0, float(sure[best]) * within))


Row = tuple[str, np.ndarray, np.ndarray]


def families_of(rows: list[Row], most: int = MAX_FAMILY) -> dict[str, list[str]]:
    """Each family's languages; large families are parted, unlike languages first."""
    size = ORDERS << BITS
    out: dict[str, list[str]] = {}
    for x in sorted({r[0] for r in rows}):
        out.setdefault(family_of(x), []).append(x)
    if all(len(v) <= most for v in out.values()):
        return out
    mean = {}
    for x, ids, v in rows:
        np.add.at(mean.setdefault(x, np.zeros(size, np.float32)), ids, v)
    for x, m in mean.items():
        mean[x] = m / max(float(np.linalg.norm(m)), 1e-30)

    def part(langs: list[str]) -> list[list[str]]:
        if len(langs) <= most:
            return [langs]
        # from the two languages that are least like each other, a few rounds of 2-means
        like = np.array([[float(mean[x] @ mean[y]) for y in langs] for x in langs])
        a, b = divmod(int(like.argmin()), len(langs))
        ends = [mean[langs[a]], mean[langs[b]]]
        for _ in range(8):
            side = [int(float(mean[x] @ ends[1]) > float(mean[x] @ ends[0])) for x in langs]
            if len(set(side)) == 1:
                side = [int(i >= len(langs) // 2) for i in range(len(langs))]
            ends = [np.mean([mean[x] for x, s in zip(langs, side) if s == k], axis=0) for k in (0, 1)]
        return part([x for x, s in zip(langs, side) if not s]) + part([x for x, s in zip(langs, side) if s])

    parted = {}
    for name, langs in out.items():
        groups = part(langs)
        parted |= {name if len(groups) == 1 else f"{name}-{i}": g for i, g in enumerate(groups)}
    return parted


def fit(rows: list[Row], spark: SparkSession | None = None) -> LanguageModel:
    """A model from (language, feature ids, values times ``SCALE``) rows; with ``spark``, tasks of
    the cluster fit the machines, to the same result."""
    size = ORDERS << BITS
    families = families_of(rows)
    member = {x: f for f, langs in families.items() for x in langs}
    keys: list[tuple[str, ...]] = [(f,) for f in families] if len(families) > 1 else []
    keys += [pair for langs in families.values() for pair in combinations(langs, 2)]

    def machine(rows: list[Row], key: tuple[str, ...]):
        if len(key) == 1:
            return _svm([r[1:] for r in rows], np.array([1 if member[r[0]] == key[0] else -1 for r in rows]), size)
        few = [r for r in rows if r[0] in key]
        return _svm([r[1:] for r in few], np.array([1 if r[0] == key[0] else -1 for r in few]), size)

    if spark is None:
        made = [machine(rows, k) for k in keys]
    else:
        shared = spark.sparkContext.broadcast(rows)  # at most MAX_ROWS rows of MAX_FEATURES features

        def run(batches):
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    w, bias, a, b = machine(shared.value, keys[i])
                    yield pa.record_batch([pa.array([i], pa.int32()), pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([[bias, a, b]], pa.list_(pa.float64()))], names=["i", "w", "rest"])

        tasks = spark.range(0, len(keys), 1, max(1, min(len(keys), 1024))).selectExpr("cast(id as int) as i")
        found = sorted(tasks.mapInArrow(run, "i int, w binary, rest array<double>").toArrow().to_pylist(), key=lambda r: r["i"]) if keys else []
        shared.unpersist()
        made = [(np.frombuffer(r["w"], np.float32), *r["rest"]) for r in found]
    n = len(made)
    ws = [(m[0] * SCALE).astype(np.float32) for m in made]

    def side(of: list[np.ndarray]) -> np.ndarray:
        return np.stack(of, 1) if of else np.zeros((size, 0), np.float32)

    column = {k: i for i, k in enumerate(keys)}
    blocks = [side(ws)]
    if n > AT_ONCE:
        blocks = [side([w for k, w in zip(keys, ws) if len(k) == 1])]
        blocks += [side([ws[column[pair]] for pair in combinations(langs, 2)]) for langs in families.values()]
    return LanguageModel(families, column, blocks, np.array([m[1] for m in made]).reshape(n), np.array([m[2:] for m in made]).reshape(n, 2))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, max_rows: int = MAX_ROWS) -> LanguageModel:
    """A model of all languages, fitted on at most ``sample`` distinct texts of each, in all at
    most ``max_rows`` or ``MIN_SAMPLE`` a language."""
    spark = docs.sparkSession
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    # one row for each language, with about how many texts it has; copies of a text are one
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).orderBy("lang").collect()
    if not counts:
        return fit([])
    sample = min(sample, max(MIN_SAMPLE, max_rows // len(counts)))
    share = spark.createDataFrame([(r.lang, min(1.0, (1.2 * sample + 20) / r.n)) for r in counts], "lang string, share double")
    # equal texts have equal places, and a text's place does not depend on its id
    place = F.pmod(F.xxhash64("text", F.lit("language sample")), F.lit(1 << 40)) / float(1 << 40)
    near = labelled.withColumn("place", place).join(F.broadcast(share), "lang").where("place < share")  # a row for each language

    def run(batches):
        for batch in batches:
            found = [sparse(t) for t in strings(batch.column(1))]
            keep = [i for i, x in enumerate(found) if x is not None]
            ids, values = [], []
            for i in keep:
                at, v = found[i]
                if len(at) > MAX_FEATURES:
                    most = np.sort(np.argsort(-v, kind="stable")[:MAX_FEATURES])
                    at, v = at[most], v[most]
                ids.append(at)
                values.append((v * SCALE).astype(np.float32))
            taken = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column(0).take(taken), batch.column(2).take(taken), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["lang", "place", "ids", "values"])

    # copies of a text have one place; what is left of a language is near `sample`, and then cut to it
    picked = near.select("lang", "text", "place").mapInArrow(run, "lang string, place double, ids array<int>, values array<float>")
    one = picked.groupBy("lang", "place").agg(F.min(F.struct("ids", "values")).alias("x"))
    ranked = one.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("_rank") <= sample)
    rows = ranked.select("lang", "x.ids", "x.values").toArrow()
    out = [(lang, np.array(i, np.int32), np.array(v)) for lang, i, v in zip(rows["lang"].to_pylist(), rows["ids"].to_numpy(), rows["values"].to_numpy())]
    del rows
    return fit(sorted(out, key=lambda r: (r[0], len(r[1]), zlib.crc32(r[1].tobytes()))), spark)


def language_column(spark: SparkSession, model: LanguageModel):
    """A column function of a text: struct<lang_pred, score>."""
    # bounded by the languages: about (MAX_FAMILY - 1) / 2 + 1 machines of 256 KB for each
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(text: pa.Array) -> pa.Array:
        found = [shared.value.predict(t) for t in strings(text)]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["lang_pred", "score"])

    return predict


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept out of learning: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_language`` (lang_pred, score).

    Only rows that are not held out and have a language teach the model; predictions use
    the whole text alone. Null texts and texts without letters are ``und`` with score 0, as is
    everything if no row has a language. Rows and other columns pass unchanged; a column named
    ``_language`` is replaced.
    """
    model = fit_languages(docs.where(~held_out(id_col)), id_col, text_col)
    return docs.withColumn("_language", language_column(docs.sparkSession, model)(F.col(text_col).cast("string")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in a language that was learned, predicted with some confidence."""
    found = language_column(spark, fit_languages(docs.where(~held_out())))(F.col("text").cast("string"))
    return docs.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= MIN_SCORE))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out().alias("held_out"), "_language.lang_pred", "_language.score")
