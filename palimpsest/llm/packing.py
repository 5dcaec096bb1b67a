"""Best-fit packing of tokenised documents by minimum bin slack.

Only lengths decide how pieces pack, and there are at most ``window`` of them, so the plan is
made from a histogram of at most ``window`` rows, whatever the corpus. A bin's longest piece is the
longest one left; a subset-sum dynamic program over bitsets of reachable sums then finds the
fullest feasible combination of the lengths that are left (Gupta and Ho's minimum bin slack).
The combination is taken out as often as the counts allow before the next is sought, so the
plan has a few thousand *patterns*, each with a number of bins. Pieces are ranked within
their length in the cluster (in shares of about ``SHARE`` pieces, however many a length has), and
the rank determines the pattern, the bin and the place in it.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Workspace, documents, strings

WINDOW = 1024
END_ID = 2
#: Empty places of a bin that plans are tried with.
SLACKS = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Pieces of one length that are ranked together; a length with more is dealt into shares.
SHARE = 100_000
#: Distinct chunks that a worker remembers, characters of texts that are cut before their new
#: chunks are encoded, and chunks that the library encodes in one text.
CACHE_CHUNKS, GROUP_CHARS, LOT = 400_000, 2_000_000, 2000
#: Rows of an Arrow batch that are in memory as pieces at a time.
ROWS = 2000


class ByteTokenizer:
    """Ids of whole texts as the tokenizers library gives them for a tokenizer file.

    All ids come from the library. Where the file splits texts by the byte-level pattern and
    nothing else looks across its edges, a text is cut at some of them, and each distinct chunk
    is encoded by the library once and remembered (up to a bound, then forgotten). Other files'
    texts, and texts with an added token's string, are encoded whole.
    """

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already run side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cuts = _cuts_by_pattern(self.library)
        #: Strings that the library takes out before it splits, as if a text ended there.
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: The id of a line feed, which no chunk without one gives.
        feed = self.library.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.bound = cache_chunks
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks by the library: those that are no white space by lots, a line feed
        between two, which has a piece of its own there."""
        alone = [c.isspace() for c in chunks] if self.feed is not None else [True] * len(chunks)
        plain = [c for c, a in zip(chunks, alone) if not a]
        found: list[bytes] = []
        for i in range(0, len(plain), LOT):
            lot = plain[i : i + LOT]
            (ids,) = self._library(["\n".join(lot)])
            at = 4 * np.flatnonzero(ids == self.feed)
            if len(at) != len(lot) - 1:
                raise ValueError("line feeds between chunks did not stay apart")
            raw = ids.tobytes()
            found += [raw[a:b] for a, b in zip([0, *(at + 4).tolist()], [*at.tolist(), len(raw)])]
        whole = iter(self._library([c for c, a in zip(chunks, alone) if a]))
        rest = iter(found)
        return [next(whole).tobytes() if a else next(rest) for a in alone]

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        every: list[str] = []
        sizes = []
        for t in texts:
            found = _CHUNK.findall(t)
            sizes.append(len(found))
            every += found
        coded = pa.array(every, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.bound:
            self.known.clear()
        blobs = list(map(self.known.get, distinct))
        if new := [i for i, ids in enumerate(blobs) if ids is None]:
            chunks = [distinct[i] for i in new]
            made = self._learn(chunks)
            self.known.update(zip(chunks, made))
            for i, ids in zip(new, made):
                blobs[i] = ids
        flat = np.frombuffer(b"".join(blobs), "<u4")
        # a group's ids are few enough for 32-bit places
        lengths = np.fromiter(map(len, blobs), np.int32, len(blobs)) >> 2
        starts = lengths.cumsum(dtype=np.int32) - lengths
        codes = coded.indices.to_numpy()
        n = lengths[codes]
        ends = np.zeros(len(n) + 1, np.int32)
        n.cumsum(out=ends[1:], dtype=np.int32)
        ids = flat[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1], dtype=np.int32)].tobytes()
        at = 4 * ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].astype(np.int64)
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        while len(out) < len(texts):
            group, size = [], 0
            for t in texts[len(out) :]:
                group.append(t)
                size += len(t)
                if size > GROUP_CHARS:
                    break
            cut = [self.cuts and not _UNLIKE.search(t) and not any(a in t for a in self.added) for t in group]
            chunked = iter(self._by_chunks([t for t, c in zip(group, cut) if c]))
            whole = iter(self._library([t for t, c in zip(group, cut) if not c]))
            out += [next(chunked) if c else next(whole).tobytes() for c in cut]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]


_LATIN, _SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
#: Runs of Latin letters, of ASCII signs but apostrophes and of digits, each with the blank before
#: it, where what follows is none of its kind; other runs without white space; and white space as
#: the byte-level pattern parts it. That has an edge wherever one of these ends.
_CHUNK = re.compile(rf" ?[{_LATIN}]+(?=[\x00-@\[-`{{-\x7f\s]|$)| ?[{_SIGNS}]+(?=[{_LATIN}0-9\s]|$)| ?[0-9]+(?=[\x00-/:-\x7f\s]|$)| ?\S+|\s+(?!\S)|\s+")
#: White space for Python's patterns only.
_UNLIKE = re.compile("[\x1c-\x1f]")


def _cuts_by_pattern(library) -> bool:
    """Whether texts cut by ``_CHUNK`` keep their ids: the file parts them by the byte-level pattern."""
    made = json.loads(library.to_str())
    if made.get("normalizer") or made.get("truncation") or made.get("padding"):
        return False
    split = made.get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True):
        return False
    if made["model"].get("dropout") or made["model"].get("type") != "BPE":
        return False
    return True


_tokenizers: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    """One tokenizer per worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of each document's tokens and ``end_id``.

    A document of more than ``window`` tokens is cut; its first piece takes what its full
    pieces leave. A null or empty text is the end id alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end = end_id.to_bytes(4, "little")

    def run(batches):
        tok = tokenizer(tokenizer_path)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                rows: list[list] = [[], [], [], [], [], []][: 5 + with_ids]
                for key, data in zip(batch.column(0).to_pylist(), tok.encode_batch(strings(batch.column(1)))):
                    data += end
                    n = len(data) // 4
                    start, size = 0, n - (n - 1) // window * window
                    for piece in range(-(-n // window)):
                        part = data[4 * start : 4 * (start + size)]
                        for column, x in zip(rows, (key, piece, start, size, zlib.crc32(part), part)):
                            column.append(x)
                        start, size = start + size, window
                kinds = (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], names=["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def fullest(room: int, lengths: list[int], counts: dict[int, int], slack: int = 0) -> dict[int, int]:
    """Lengths, no more of each than there are, whose sum is the largest that ``room`` holds.

    Bit s of a bitset tells whether some choice of the lengths so far sums to s. Long pieces
    come first, so that among the fullest choices the short ones are kept for later bins.
    With ``slack``, shorter pieces are left out once a choice comes within it.
    """
    mask = (1 << room + 1) - 1
    seen, stages = 1, []
    for n in lengths:
        if n > room:
            continue
        before, copies, step = seen, min(counts[n], room // n), 1
        while copies > 0:  # 1, 2, 4, ... copies make up any number
            take = min(step, copies)
            seen |= seen << take * n & mask
            copies, step = copies - take, step * 2
        stages.append((n, before))
        if seen >> max(0, room - slack):
            break
    left, chosen = seen.bit_length() - 1, {}
    for n, before in reversed(stages):
        k = 0
        while not before >> left & 1:
            left, k = left - n, k + 1
        if k:
            chosen[n] = k
    return chosen


def plan(histogram: dict[int, int], window: int = WINDOW, slacks: tuple[int, ...] = SLACKS) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> copies in one bin) and how many bins each fills, for all pieces.

    Filling the first bins to the brim may use up the short pieces that the last ones need, so
    plans are made for several slacks that a bin may have; the one with the fewest bins wins.
    """
    if any(not 0 < n <= window for n, c in histogram.items() if c):
        raise ValueError(f"lengths must lie between 1 and {window}")
    least = -(-sum(n * c for n, c in histogram.items()) // window)
    best, fewest = [], None
    for slack in slacks:
        made = _plan({n: c for n, c in histogram.items() if c}, window, slack)
        bins = sum(b for _, b in made)
        if fewest is None or bins < fewest:
            best, fewest = made, bins
        if fewest == least:
            break
    return best


def _plan(counts: dict[int, int], window: int, slack: int) -> list[tuple[dict[int, int], int]]:
    out = []
    while counts:
        lengths = sorted(counts, reverse=True)
        top = lengths[0]
        counts[top] -= 1
        pattern = fullest(window - top, lengths, counts, slack)
        counts[top] += 1
        pattern[top] = pattern.get(top, 0) + 1
        bins = min(counts[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            counts[n] -= k * bins
            if not counts[n]:
                del counts[n]
        out.append((pattern, bins))
    return out


def best_fit_pack(parts: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """``parts`` (id, piece, length, ...) with ``sequence_id`` and ``offset``.

    Every piece gets a place in one sequence of at most ``window`` tokens; the places of a
    sequence follow each other without a gap from 0. Equal pieces are told apart by their
    ranks, so repeated rows get places of their own. An empty table gives an empty table.
    """
    space = Workspace(parts.sparkSession, "packing")
    parts = space.write(parts, "parts")
    # at most `window` rows
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = {n: -(-c // share) for n, c in histogram.items()}
    wide = max([0, *(n for n in salts)]) + 1
    dealt_in = F.element_at(F.array(*[F.lit(salts.get(n, 1)) for n in range(wide)]), F.col("length").cast("int") + 1)
    dealt = parts.withColumn("_salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), dealt_in.cast("long")).cast("int"))
    ranked = Window.partitionBy("length", "_salt").orderBy("id", "piece", "ids_crc32")
    # written once: ranks among equal rows must not change when a task runs again
    dealt = space.write(dealt.withColumn("_rank", F.row_number().over(ranked).cast("long") - 1), "dealt")
    # one number for each share: at most `window` more than there are rows by `share`
    shares = dealt.groupBy("length", "_salt").agg(F.count("*").alias("n")).collect()
    first: dict[int, np.ndarray] = {n: np.zeros(k + 1, dtype=np.int64) for n, k in salts.items()}
    for length, salt, n in shares:
        first[length][salt + 1] = n
    first = {n: sizes.cumsum() for n, sizes in first.items()}
    slots = []  # (length, first rank, copies in a bin, first sequence, offset)
    used: dict[int, int] = {}
    sequence = 0
    for pattern, bins in plan(histogram, window):
        offset = 0
        for n, k in sorted(pattern.items(), reverse=True):
            slots.append((n, used.get(n, 0), k, sequence, offset))
            used[n] = used.get(n, 0) + k * bins
            offset += n * k
        sequence += bins
    slots.sort()
    table = np.array(slots, dtype=np.int64).reshape(-1, 5)
    begins = [int(x) for x in np.searchsorted(table[:, 0], np.arange(window + 2))]
    # bounded: each pattern uses up what is left of a length, or halves it
    shared = parts.sparkSession.sparkContext.broadcast((table, begins, first))

    def run(batches):
        table, begins, first = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            salt, rank = batch.column("_salt").to_numpy(), batch.column("_rank").to_numpy().copy()
            row = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                at = length == n
                rank[at] += first[n][salt[at]]
                a, b = begins[n], begins[n + 1]
                row[at] = a + np.searchsorted(table[a:b, 1], rank[at], side="right") - 1
            of = rank - table[row, 1]
            sequence = table[row, 3] + of // table[row, 2]
            offset = table[row, 4] + of % table[row, 2] * length
            kept = [c for c, name in zip(batch.columns, batch.schema.names) if name not in ("_salt", "_rank")]
            names = [name for name in batch.schema.names if name not in ("_salt", "_rank")]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): its place in the packed sequences.

    Null and empty texts give one piece of one token. Rows that share an id each get their
    pieces. Other columns are left out.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return best_fit_pack(pieces(docs, tokenizer_path)).withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
