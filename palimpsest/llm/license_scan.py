"""Licence scans by sentence rules.

A text is a sequence of normalised words (letters and digits in lower case, and a plus after
them) and sentence ends. A mark that white space follows ends a sentence, as does a blank line
or one of signs alone; a line feed does not, so that sentences may be wrapped anywhere, behind
comment signs too. Known
licence sentences are mapped to identifiers: one begins where a sentence or a line begins, after
a list marker there, or after the verb of its first words ("this package is ..."), and ends
where a sentence or line ends; references to a licence by its name may end anywhere. ``<*>`` in a
known sentence stands for 1 to ``STAR`` words of one sentence, such as a holder's name.

The sequence of identifiers is then matched against ordered rules: a rule is a licence and a
sequence of sentences that must follow one another, with at most ``gap`` unknown sentences
between two. Where rules overlap the one of most sentences wins, then the one of most words,
then the first in the text.

Known sentences and names are data files of public texts (``data/licence_texts.txt``,
``data/licence_names.txt``, which name their source and licence). A reference is any of
``VERBS`` before a name, or an SPDX tag before an identifier. Work is in proportion to the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import documents, strings

Rule = tuple[str, str, list[str]]
DATA = Path(__file__).parent / "data"
#: Unknown sentences that may stand between two of a rule's, and words that a star stands for.
GAP, STAR = 2, 12
#: What comes before a licence's name in a reference to it.
_VERBS = ("licensed", "released", "distributed", "available", "published", "provided", "redistributed", "covered", "dual licensed", "made available", "issued", "offered")
VERBS = [
    f"{verb} under {terms}{the}"
    for verb in _VERBS
    for terms in ("", "the terms of ", "the terms and conditions of ", "the conditions of ")
    for the in ("", "the ", "a ", "an ")
]
#: Verbs that a known sentence may follow, within so many words of its sentence's begin.
_IS, LEAD = frozenset("is are be was been may can being".split()), 10
_TOKEN = re.compile(r"([^\W_]+\+?)|([.!?;:]+[\"'”’)\]]*(?=\s|$)|\n[^\S\n]*[^\w\n]{0,8}[^\S\n]*(?=\n))|(\n)")
#: What a text with a reference has, in lower case.
_REFERS = re.compile(rf"(?:{'|'.join(v.split()[-1] for v in _VERBS)})[\W_]+under")
END, ANY = "|", "*"


def tokens(text: str) -> tuple[list[str], list[int], list[int], list[bool]]:
    """Words and sentence ends of a text, where each begins and ends, and whether it begins a line."""
    words, starts, ends, fresh = [], [], [], []
    new = True
    for m in _TOKEN.finditer(text):
        kind = m.lastindex
        if kind == 3:
            new = True
            continue
        if kind == 2 and (not words or words[-1] == END):
            new = True
            continue
        words.append(m[0].lower().replace("licence", "license") if kind == 1 else END)
        starts.append(m.start())
        ends.append(m.end())
        fresh.append(new)
        new = kind == 2
    return words, starts, ends, fresh


def _known_tokens(sentence: str) -> list[str]:
    """A known sentence's words and ends, without the last end; a star for each ``<*>``."""
    out: list[str] = []
    for i, part in enumerate(sentence.split("<*>")):
        out += [ANY] * bool(i) + tokens(part)[0]
    while out and out[-1] == END:
        out.pop()
    return out


def read_rules(names: str | None = None, texts: str | None = None) -> list[Rule]:
    """The rules of the data files. References have rule "reference"; their sentence is the name."""
    names = (DATA / "licence_names.txt").read_text("utf-8") if names is None else names
    texts = (DATA / "licence_texts.txt").read_text("utf-8") if texts is None else texts
    rules: list[Rule] = []
    for line in texts.splitlines():
        if line.startswith("= "):
            licence, rule = line[2:].split(" | ")
            rules.append((licence, rule, []))
        elif line and line[0] != "#":
            rules[-1][2].append(line)
    for line in names.splitlines():
        if line and line[0] != "#":
            licence, *known = line.split(" | ")
            rules += [(licence, "reference", [name]) for name in known]
            rules.append((licence, "identifier", [f"SPDX-License-Identifier: {licence}"]))
    return rules


@dataclass(frozen=True)
class Match:
    licence: str
    rule: str
    start: int
    end: int


class SentenceRules:
    """Known sentences with identifiers, in a tree of their words, and rules over their sequences."""

    def __init__(self, rules: list[Rule], gap: int = GAP):
        self.gap = gap
        self.known: dict[tuple[str, ...], int] = {}
        self.anywhere: set[int] = set()
        self.by_first: dict[int, list[tuple[str, str, list[int]]]] = {}
        self.root: dict = {}
        self.anchors: set[str] = set()
        for licence, rule, sentences in rules:
            if rule == "reference":
                for verb in VERBS:
                    self._add(licence, rule, [f"{verb}{name}" for name in sentences], True, True)
            else:
                self._add(licence, rule, sentences, rule == "identifier", False)
        for found in self.by_first.values():
            found.sort(key=lambda r: -len(r[2]))

    def _add(self, licence: str, rule: str, sentences: list[str], anywhere: bool, reference: bool) -> None:
        ids = []
        for s in sentences:
            words = tuple(_known_tokens(s))
            if not words:
                continue
            number = self.known.setdefault(words, len(self.known))
            ids.append(number)
            if anywhere:
                self.anywhere.add(number)
            node = self.root
            for w in words:
                node = node.setdefault(w, {})
            node[0] = number
            if not reference:  # a text with a known sentence has its longest word
                self.anchors.add(max((w for w in words if w not in (END, ANY)), key=len))
        if ids:
            self.by_first.setdefault(ids[0], []).append((licence, rule, ids))

    def _ends(self, words: list[str], fresh: list[bool], at: int) -> list[tuple[int, int]]:
        """(identifier, place after it) of the known sentences that begin at a place."""
        found, todo = [], [(self.root, at)]
        while todo:
            node, i = todo.pop()
            number = node.get(0)
            if number is not None and (number in self.anywhere or i == len(words) or words[i] == END or fresh[i]):
                found.append((number, i))
            if i == len(words):
                continue
            if (after := node.get(words[i])) is not None:
                todo.append((after, i + 1))
            if (after := node.get(ANY)) is not None:
                for j in range(i + 1, min(i + STAR, len(words)) + 1):
                    if words[j - 1] == END:
                        break
                    todo.append((after, j))
        return found

    def _begins(self, words: list[str], fresh: list[bool]) -> list[int]:
        """Places where a known sentence may begin, ascending."""
        out, since = [], LEAD
        for i, w in enumerate(words):
            if w == END:
                since = -1
                continue
            first = fresh[i] or since < 0 or i == 0
            since = 0 if first else since + 1
            if first or (since <= LEAD and words[i - 1] in _IS) or (since == 1 and (len(words[i - 1]) == 1 or words[i - 1].isdigit())):
                out.append(i)
        return out

    def sequence(self, text: str) -> tuple[list[tuple[int, dict[int, int]]], tuple]:
        """Places where known sentences begin, with their identifiers and ends; and the tokens."""
        low = text.lower().replace("licence", "license")
        if not any(a in low for a in self.anchors) and not ("under" in low and _REFERS.search(low)):
            return [], ([], [], [], [])
        made = words, _, _, fresh = tokens(text)
        root = self.root
        found = []
        for at in self._begins(words, fresh):
            if words[at] in root or ANY in root:
                if ids := self._ends(words, fresh, at):
                    best: dict[int, int] = {}
                    for number, end in ids:
                        best[number] = max(end, best.get(number, 0))
                    found.append((at, best))
        return found, made

    def scan(self, text: str) -> tuple[int, list[Match]]:
        """(sentences that are known, the longest of those that overlap; matches in the text's order)."""
        found, (words, starts, ends, _) = self.sequence(text)
        if not found:
            return 0, []
        # unknown sentences between two places: sentence ends between them, less the first one's own
        stops = [i for i, w in enumerate(words) if w == END]
        known, last = 0, 0
        for at, ids in found:
            if at >= last:
                known, last = known + 1, max(ids.values())
        candidates = []
        for n, (at, ids) in enumerate(found):
            best = None
            for number in ids:
                for licence, rule, want in self.by_first.get(number, ()):
                    if best is not None and len(want) < best[0]:
                        break
                    end = self._follow(found, stops, n, ids[number], want[1:])
                    if end is not None:
                        score = (len(want), end - at, licence, rule)
                        if best is None or score[:2] > best[:2]:
                            best = score
            if best is not None:
                candidates.append((-best[0], -best[1], at, best[2], best[3]))
        used, out = bytearray(len(words)), []
        for _, size, at, licence, rule in sorted(candidates):
            if used.find(1, at, at - size) < 0:
                used[at : at - size] = b"\x01" * -size
                out.append((at, Match(licence, rule, starts[at], ends[at - size - 1])))
        return known, [m for _, m in sorted(out, key=lambda x: x[0])]

    def _follow(self, found, stops: list[int], n: int, end: int, want: list[int]) -> int | None:
        """The end of a rule's other sentences, each the next of its kind; None if one is too far."""
        for number in want:
            ended = bisect_left(stops, end)
            n += 1
            while True:
                if n == len(found):
                    return None
                at, ids = found[n]
                if at >= end:
                    if bisect_left(stops, at) - ended > self.gap + 1:
                        return None
                    if number in ids:
                        end = ids[number]
                        break
                n += 1
        return end


_compiled: dict[tuple, SentenceRules] = {}


def compiled(rules: list[Rule], gap: int = GAP) -> SentenceRules:
    """The rules' tree, made once in a process."""
    key = (gap, *((a, b, tuple(c)) for a, b, c in rules))
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = SentenceRules(rules, gap)
    return _compiled[key]


def license_scan(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, gap: int = GAP) -> DataFrame:
    """``docs`` with a struct column ``_licences``: n_known and matches (licence, rule, start, end).

    Offsets are code points of the whole text. Null and empty texts have no match. Rows and
    other columns pass unchanged; a column named ``_licences`` is replaced.
    """
    rules = read_rules() if rules is None else rules  # read here, so that workers need no files

    @F.arrow_udf("struct<n_known:bigint,matches:array<struct<licence:string,rule:string,start:bigint,end:bigint>>>")
    def scan(text: pa.Array) -> pa.Array:
        known = compiled(rules, gap)
        found = [known.scan(t) for t in strings(text)]
        match = pa.struct([("licence", pa.string()), ("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([[vars(m) for m in ms] for _, ms in found], pa.list_(match))], names=["n_known", "matches"])

    return docs.withColumn("_licences", scan(F.col(text_col).cast("string")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its known sentences, its matches and the licences they name."""
    found = license_scan(documents(spark, sf_dir).select("doc_id", "text"))
    licences = F.array_sort(F.array_distinct(F.transform("_licences.matches", lambda m: m["licence"])))
    return found.select("doc_id", F.col("_licences.n_known").alias("n_known"), F.size("_licences.matches").cast("long").alias("n_matches"), F.array_join(licences, ",").alias("licences"))
