"""Licence scans: sentences, ordered rules, overlaps, wrapped texts and the cases its docstring defines."""

import random
import re
import textwrap
import time
from pathlib import Path

import pytest

from palimpsest.llm import license_scan as S

SF = Path("/root/testdata/sf0.001")
RULES = [("A", "short", ["First sentence."]), ("A", "long", ["First sentence.", "Second sentence.", "Third one"]), ("B", "tail", ["Third one", "Fourth one"])]
ALL = S.read_rules()
KNOWN = S.SentenceRules(ALL)


def found(text, rules=RULES, gap=1):
    return [(m.licence, m.rule) for m in S.SentenceRules(rules, gap).scan(text)[1]]


def licences(text):
    return sorted({m.licence for m in KNOWN.scan(text)[1]})


def test_sequences_must_be_in_order_and_close():
    assert found("First sentence. Second sentence. Third one.") == [("A", "long")]
    assert found("first SENTENCE! \n second, sentence. Unknown words. third one") == [("A", "long")]
    assert found("First sentence. Unknown. Unknown. Second sentence. Third one.") == [("A", "short")]  # too far apart
    assert found("Second sentence. First sentence. Third one.") == [("A", "short")]
    assert found("First sentence. Second sentence.") == [("A", "short")]
    assert found("") == [] and found(" \n\n ") == [] and found("nothing known here") == []


def test_overlaps_take_the_longest_then_the_first():
    # the third sentence belongs to the longer rule
    assert found("First sentence. Second sentence. Third one. Fourth one.") == [("A", "long")]
    assert found("Third one. Fourth one. First sentence.") == [("B", "tail"), ("A", "short")]
    assert found("First sentence. First sentence.") == [("A", "short"), ("A", "short")]


def brute(text, rules, gap):
    """Candidates by trying every start and every rule over split sentences, without an index."""
    def plain(s):
        return " ".join(re.findall(r"[a-z]+", s.lower()))

    sent = [plain(s) for s in re.split(r"[.!?]\s*", text) if plain(s)]
    cands = []
    for i in range(len(sent)):
        best = None
        for licence, rule, want in rules:
            want = list(map(plain, want))
            at, ok = i, sent[i] == want[0]
            for w in want[1:]:
                nxt = [j for j in range(at + 1, len(sent)) if sent[j] == w and j - at <= gap + 1] if ok else []
                ok, at = bool(nxt), nxt[0] if nxt else at
            if ok and (best is None or len(want) > best[0]):
                best = (len(want), sum(len(s.split()) + 1 for s in sent[i : at + 1]), i, at, licence, rule)
        cands += [best] if best else []
    out, used = [], set()
    for _, _, a, b, licence, rule in sorted(cands, key=lambda c: (-c[0], -c[1], c[2])):
        if not used & set(range(a, b + 1)):
            used |= set(range(a, b + 1))
            out.append((a, licence, rule))
    return [(licence, rule) for _, licence, rule in sorted(out)]


def test_equals_brute_force_on_shuffled_sentences():
    rng = random.Random(1)
    pool = ["First sentence.", "Second sentence.", "Third one.", "Fourth one.", "Something else."]
    for _ in range(400):
        text = " ".join(rng.choices(pool, k=rng.randrange(0, 12)))
        for gap in (0, 1, 2):
            assert found(text, RULES, gap) == brute(text, RULES, gap), text


@pytest.mark.parametrize("width", [None, 60, 78, 100])
@pytest.mark.parametrize("sign", ["", "# ", " * "])
def test_every_text_is_found_however_wrapped(width, sign):
    texts = [r for r in ALL if r[1] not in ("reference", "identifier")]
    assert len(texts) > 35
    for licence, rule, sentences in texts:
        text = " ".join(s.replace("<*>", "The Example Holders, Inc") for s in sentences)
        lines = textwrap.wrap(text, width) if width else [text]
        body = "\n".join(sign + x for x in lines)
        # the rule that fits best has the name; texts that share sentences are told apart
        assert licence in licences(f"Some words before.\n\n{body}\n\nSome words after."), (licence, rule)


def test_every_name_is_found_as_a_reference():
    for licence, rule, sentences in ALL:
        if rule == "reference":
            for text in (f"Released under the {sentences[0]}.", f"This package is licensed under the terms of the\n{sentences[0]}", f"Foo is free. It may be distributed under the {sentences[0]} by anyone."):
                assert any(m.licence == licence for m in KNOWN.scan(text)[1]), (licence, text)
        if rule == "identifier":
            assert licences(f"// SPDX-License-Identifier: {licence}\nint x;") == [licence]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Licensed under the Apache License,\nVersion 2.0", ["Apache-2.0"]),
        ("This package is released under the MIT License.", ["MIT"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("Released under the GNU General Public License, version 3 or later.", ["GPL-3.0-or-later"]),
        ("A text about the MIT License and how licences work.", []),
        ("We drove under the MIT bridge.", []),
    ],
)
def test_references(text, want):
    assert licences(text) == want


def test_stars_stay_in_a_sentence():
    rules = [("X", "text", ["Neither <*> nor others may sue."])]
    assert found("Neither the name of Foo nor others may sue.", rules) == [("X", "text")]
    assert found("Neither. The name nor others may sue.", rules) == []
    assert found(f"Neither {'a ' * 13}nor others may sue.", rules) == []


@pytest.mark.parametrize("text", ["Released under the MIT License.\n" * 160_000, "Redistribution and use in source and binary forms,\n" * 100_000, "is " * 400_000 + "licensed", ". " * 400_000 + "license", "\n#" * 400_000 + "license"])
def test_long_texts_take_linear_time(text):
    began = time.process_time()
    KNOWN.scan(text)
    assert time.process_time() - began < 12


def test_column(spark):
    text = "Été. Licensed under the Apache License, Version 2.0. More."
    rows = [(1, text, "x"), (1, text, "x"), (2, None, None), (None, "", "y"), (3, "word " * 200_000 + ". " + text, "z")]
    out = S.license_scan(spark.createDataFrame(rows, "doc_id long, text string, matches string")).collect()
    assert len(out) == 5
    for r in out:
        if r.text and "Apache" in r.text:
            (m,) = r._licences.matches
            assert m.licence == "Apache-2.0" and "Apache License, Version 2.0" in r.text[m.start : m.end] and r.matches in ("x", "z")
        else:
            assert r._licences.n_known == 0 and r._licences.matches == []
    assert S.license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


#: What the tables' licence lines name.
LINES = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_finds_the_tables_lines(spark, sf):
    folder = str(SF.parent / sf)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d in docs:
        lines = [LINES[x.strip()] for x in (d.text or "").split("\n") if x.strip() in LINES]
        want[d.doc_id] = (len(lines), len(lines), ",".join(sorted(set(lines))))
    got = {r.doc_id: (r.n_known, r.n_matches, r.licences) for r in S.op2_license_scan(spark, folder).collect()}
    assert got == want
