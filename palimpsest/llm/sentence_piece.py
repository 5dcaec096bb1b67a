"""Encoding and decoding with a merge-type (BPE) SentencePiece model.

A chunk of text starts as single characters. An agenda holds every adjacent pair whose
concatenation is a piece, the best score first and the leftmost among equals; the best pair
is merged and its new neighbours enter the agenda, until it is empty. The agenda of a long
chunk is a heap; those of all new chunks of a length are the rows of an array, of which each
round takes every row's best pair. Characters that are no piece become the byte pieces of
their UTF-8 form.

No merge crosses the edge between a character and a word mark, or touches a character that
only stands alone in the vocabulary (a line feed, say), as no piece spans such an edge. So a
text is cut there and each distinct chunk is encoded once by a worker (up to a bound, then
forgotten). Each new chunk's ids are held against the sentencepiece library's, all new chunks
of an Arrow batch in one call; a difference raises. The library decodes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Memo, documents, strings

MARK = "▁"
#: Distinct chunks that a worker remembers.
CACHE_CHUNKS = 450_000
#: Longest chunk, and fewest chunks of a length, whose agendas are rows of an array.
SHORT, FEW = 48, 8
#: Texts that are cut before their new chunks are encoded at once, and their characters.
GROUP, GROUP_CHARS = 256, 2_000_000
_SHIFT, _SLOTS, _NONE, _GONE = 20, 20, 1 << 60, -2


class PairTable:
    """For two symbols side by side, the place of the piece they make in the order of scores, and
    its id. Characters of pieces that are no piece have numbers after all ids, others -1."""

    def __init__(self, vocab: dict[str, tuple[float, int]], size: int):
        chars = sorted({c for p in vocab for c in p})
        ids = {c: vocab[c][1] if c in vocab else size + i for i, c in enumerate(chars)} | {p: i for p, (_, i) in vocab.items()}
        self.size = size
        self.number = np.full(0x110000, -1, np.int64)
        for c in chars:
            self.number[ord(c)] = ids[c]
        place = {score: i for i, score in enumerate(sorted({score for score, _ in vocab.values()}))}
        rows = [(ids[p[:k]] << _SHIFT | ids[p[k:]], place[score], i) for p, (score, i) in vocab.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        self.fits = size + len(chars) < 1 << _SHIFT and len(rows) < 1 << _SLOTS - 2
        if not self.fits:
            return
        keys, self.places, self.ids = np.array(rows, np.int64).reshape(-1, 3).T
        # open addressing: a key lies at most `probes` - 1 slots after its own
        self.keys, self.row, self.probes = np.full(1 << _SLOTS, -1, np.int64), np.zeros(1 << _SLOTS, np.int32), 1
        for i, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            step = 0
            while self.keys[(slot + step) & (1 << _SLOTS) - 1] >= 0:
                step += 1
            self.keys[(slot + step) & (1 << _SLOTS) - 1], self.row[(slot + step) & (1 << _SLOTS) - 1] = key, i
            self.probes = max(self.probes, step + 1)

    def __bool__(self) -> bool:
        return self.fits

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, id) of each pair; a pair that makes no piece comes after all others."""
        key = np.where((a >= 0) & (b >= 0), a << _SHIFT | b, -3)
        slot = self._slot(key)
        row = np.full(key.shape, -1, np.int32)
        for step in range(self.probes):
            at = (slot + step) & (1 << _SLOTS) - 1
            hit = self.keys[at] == key
            row[hit] = self.row[at[hit]]
        return np.where(row >= 0, self.places[row], _NONE), self.ids[row]


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class AgendaEncoder:
    """Encoder and decoder for one model file. ``check=False`` leaves the library's check out."""

    def __init__(self, model_path: str, check: bool = True, cache_chunks: int = CACHE_CHUNKS):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.check = check
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        self.vocab = {sp.id_to_piece(i): (-sp.get_score(i), i) for i in range(size) if not special[i]}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        joined = {c for p in self.vocab if len(p) > 1 for c in p}
        #: Characters that stand side by side in some piece.
        self.joins = {p[i : i + 2] for p in self.vocab for i in range(len(p) - 1)}
        self.pairs = PairTable(self.vocab, size)
        spans = any(MARK in p.lstrip(MARK) for p in self.vocab)
        #: Whether texts can be cut before word marks and at line feeds.
        self.cuts = not spans and "\n" not in joined
        self.known = Memo(cache_chunks)
        self.chunks = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")

    def merge(self, chunk: str) -> list[int]:
        """The ids of a chunk, in which blanks are already word marks, by the agenda."""
        vocab, sym = self.vocab, list(chunk)
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            if (e := vocab.get(sym[i] + sym[i + 1])) is not None:
                agenda.append((e[0], i, i + 1, len(sym[i]) + len(sym[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            # stale if either symbol has merged since
            if not sym[i] or not sym[j] or len(sym[i]) + len(sym[j]) != size:
                continue
            sym[i] += sym[j]
            sym[j] = ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (e := vocab.get(sym[i] + sym[k])) is not None:
                    heapq.heappush(agenda, (e[0], i, k, len(sym[i]) + len(sym[k])))
            h = left[i]
            if h >= 0 and (e := vocab.get(sym[h] + sym[i])) is not None:
                heapq.heappush(agenda, (e[0], h, i, len(sym[h]) + len(sym[i])))
        ids: list[int] = []
        for s in sym:
            if s:
                e = vocab.get(s)
                ids.extend([e[1]] if e else [self.bytes[b] for b in s.encode()])
        return ids

    def merge_all(self, chunks: list[str]) -> list[bytes]:
        """The packed ids of each chunk."""
        out: list[bytes] = [b""] * len(chunks)
        by: dict[int, list[int]] = {}
        for i, c in enumerate(chunks):
            by.setdefault(len(c), []).append(i)
        for n, at in by.items():
            if n > SHORT or len(at) < FEW or not self.pairs:
                for i in at:
                    out[i] = _packed(self.merge(chunks[i]))
                continue
            lot = 1_000_000 // n
            for k in range(0, len(at), lot):
                for i, ids in zip(at[k : k + lot], self._merge_equal([chunks[i] for i in at[k : k + lot]])):
                    out[i] = ids
        return out

    def _merge_equal(self, chunks: list[str]) -> list[bytes]:
        """``merge`` of chunks of one length, a round of all their agendas at a time."""
        n, find = len(chunks[0]), self.pairs.find
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        sym = self.pairs.number[codes]
        place, made = np.full(sym.shape, _NONE), np.zeros_like(sym)
        place[:, :-1], made[:, :-1] = find(sym[:, :-1], sym[:, 1:])
        right, left = np.tile(np.arange(1, n + 1), (len(sym), 1)), np.tile(np.arange(-1, n - 1), (len(sym), 1))
        rows = np.arange(len(sym))
        while True:
            i = place[rows].argmin(1)  # the leftmost of the best
            live = place[rows, i] < _NONE
            rows, i = rows[live], i[live]
            if not len(rows):
                break
            j = right[rows, i]
            k = right[rows, j]
            sym[rows, i], sym[rows, j] = made[rows, i], _GONE
            place[rows, i] = place[rows, j] = _NONE
            right[rows, i] = k
            some = k < n
            r, a, b = rows[some], i[some], k[some]
            left[r, b] = a
            place[r, a], made[r, a] = find(sym[r, a], sym[r, b])
            h = left[rows, i]
            some = h >= 0
            r, a, b = rows[some], h[some], i[some]
            place[r, a], made[r, a] = find(sym[r, a], sym[r, b])
        stays = sym != _GONE
        flat = sym[stays].astype("<u4").tobytes()
        ends = (4 * stays.sum(1).cumsum()).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for w in np.flatnonzero((stays & ((sym < 0) | (sym >= self.pairs.size))).any(1)).tolist():
            out[w] = _packed(self.merge(chunks[w]))  # characters that are no piece
        return out

    def cut(self, text: str) -> list[str]:
        """Chunks that no merge connects; their ids in a row are the text's ids."""
        if not text:
            return []
        if not self.cuts:
            return [MARK + text.replace(" ", MARK)]
        if "  " in text or MARK in text or text[0] == " " or "\r" in text:
            return self.chunks.findall(MARK + text.replace(" ", MARK))
        # a lone blank becomes the mark of the word it precedes
        return (MARK + text.replace(" ", f" {MARK}").replace("\n", " \n ")).split(" ")

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks by the agenda into ``known`` and checks them against the library."""
        # no merge crosses two characters that no piece joins, so that a last character of that
        # kind (a full stop, say) leaves the ids of the rest
        parts = [(c[:-1], c[-1]) if len(c) > 1 and c[-2:] not in self.joins else (c, "") for c in chunks]
        new = self.known.lacks([x for part in parts for x in part])
        self.known.update(zip(new, self.merge_all(new)))
        made = [self.known[a] + self.known[b] for a, b in parts]
        if self.check:
            # the library puts a mark before each text; a text that has none is given after a line feed
            begins = [c.startswith(MARK) and len(c) > 1 for c in chunks]
            expected = self.library.encode([c[1:] if b else "\n" + c for c, b in zip(chunks, begins)], num_threads=1)
            lead = len(self.library.encode("\n"))
            for c, b, ids, e in zip(chunks, begins, made, expected):
                if ids != _packed(e if b else e[lead:]):
                    raise ValueError(f"the agenda's ids differ from the library's for {c[:80]!r}")
        self.known.update(zip(chunks, made))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, with begin and end."""
        begin, end = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little")
        out: list[bytes] = []
        while len(out) < len(texts):
            cuts, size = [], 0
            for text in texts[len(out) : len(out) + GROUP]:
                cuts.append(self.cut(text))
                size += len(text)
                if size > GROUP_CHARS:
                    break
            found = [list(map(self.known.get, chunks)) for chunks in cuts]
            missing = [c for chunks, parts in zip(cuts, found) if None in parts for c, p in zip(chunks, parts) if p is None]
            if new := self.known.lacks(missing):
                self.learn(new)
            for chunks, parts in zip(cuts, found):
                if None in parts:
                    parts = [self.known[c] if p is None else p for c, p in zip(chunks, parts)]
                out.append(begin + b"".join(parts) + end)
            self.known.turn()
        return out

    def decode(self, ids) -> str:
        """The text of ids, by the library."""
        return self.library.decode(list(ids))


_encoders: dict[tuple, AgendaEncoder] = {}


def encoder(model_path: str, check: bool = True) -> AgendaEncoder:
    """One encoder per worker process and model."""
    if (model_path, check) not in _encoders:
        _encoders[model_path, check] = AgendaEncoder(model_path, check)
    return _encoders[model_path, check]


def sentencepiece_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """(id, n_tokens, ids binary, decoded): the whole text's ids, begin and end ids included.

    ``ids`` holds little-endian unsigned 32-bit integers; ``decoded`` is what they decode to.
    A null text counts as empty: begin and end ids only, decoded to ''. Ids may be null or
    repeat; each row gives a row. Other columns are left out. One row's text is in memory at
    a time besides its Arrow batch.
    """
    def run(batches):
        enc = encoder(model_path, check)
        for batch in batches:
            ids = enc.encode_batch(strings(batch.column(1)))
            decoded = [enc.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.record_batch([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = sentencepiece_encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
